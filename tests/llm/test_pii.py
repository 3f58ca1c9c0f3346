"""Spans that the generators add to the base spans."""

import random

from spheretiles.llm import pii


def added(spark, planted):
    """For each planted text the matches among pii_spans that are not among pii_base, beside 400 plain documents."""
    plain = [f"see joe{i}@example.com on 2024-01-{i % 20 + 10} 10:00" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate([*planted, *plain])), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.pii(docs).where(f"doc_id < {len(planted)}").collect()}
    return [[x["m"] for x in found[i]["pii_spans"] if x not in found[i]["pii_base"]] for i in range(len(planted))]


def test_spans_of_the_lowest_accepted_score_are_added(spark):
    # all e-mails here score 0.9669..., which the calibration rounds up to the threshold 0.967
    assert added(spark, ["mail joe (at) example [dot] com"]) == [["joe (at) example [dot] com"]]


def test_addresses_disguised_by_the_dot_alone_are_added(spark):
    assert added(spark, ["mail bob@host[dot]com", "mail bob@host (dot) com", "mail robert@hostname . com"]) == [["bob@host[dot]com"], ["bob@host (dot) com"], ["robert@hostname . com"]]


def test_numbers_that_start_like_a_date_are_scored(spark, monkeypatch):
    monkeypatch.setattr(pii, "train", lambda *a, **k: ("1D", [0.5] * 4))
    numbers = ["0151 23 45 67", "0151 23 45 12", "4444-33-22-1111-0000"]
    dates = ["2024-01-15", "2024-01-15 10:30", "15.01.2024 23.59", "2024-01-15 2024-01-20", "0151 23 45", "2024-01-15 10-30-00", "01/02/2024-03/02/2024"]
    assert added(spark, [f"on {x}, then" for x in numbers + dates]) == [*[[x] for x in numbers], *[[]] * len(dates)]


def test_thresholds_come_from_all_documents(spark):
    # one in fifty documents has an address; a sample of twenty leaves most kinds without a labelled match in its held half
    from pyspark.sql import functions as F

    texts = [f"call +1 555 {1000000 + i} or 2024-01-{i % 20 + 10}" + (f" joe{i}@example.com 10.0.0.{i % 250}" if i % 50 == 7 else "") for i in range(1000)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    key = F.regexp_extract("text", r" ([0-9]+) or", 1).cast("long") - 1000000 + F.when(F.contains("text", F.lit("@")), 1000).otherwise(0)
    _, limits = pii.train(docs, "text", key, 20)
    assert limits[0] is not None and limits[1] is not None and limits[3] is not None


def test_disguised_spans_are_added_and_decoys_are_not(spark):
    from pyspark.sql import functions as F

    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881", "4222 2222 2222 2220"]
    wrong = ["4111 1111 1111 1112", "5500 0000 0000 0005", "4012 8888 8888 1882"]
    rng = random.Random(8)
    host = lambda: ".".join(str(rng.randrange(1, 256)) for _ in range(4))
    phone = lambda: f"+{rng.choice([1, 33, 49, 351])} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)} {rng.randrange(1000, 9999)}"
    name = lambda: "".join(rng.choice("abdeilmnorst") for _ in range(rng.randrange(2, 9)))
    plain = [f"mail {name()}{rng.choice(['', '.', '_'])}{name()}@{name()}.{rng.choice(['org', 'com', 'co.uk', 'example.com'])} or host {host()}, card {(cards + wrong)[i % 7]} and {(wrong + cards)[i % 5]}. We met at {name()}. Then call {phone()} on 2024-03-{i % 20 + 10}" for i in range(600)]
    planted = {
        "write eve (at) mail [dot] example [dot] com now": ["eve (at) mail [dot] example [dot] com"],
        "write eve[at]example[dot]org now": ["eve[at]example[dot]org"],
        "host 192[.]168[.]10[.]77 is up": ["192[.]168[.]10[.]77"],
        "card 4111  1111  1111  1111 it is": ["4111  1111  1111  1111"],
        "card 4012--8888--8888--1881 it is": ["4012--8888--8888--1881"],
        "call 0049 151 2345 6789 today": ["0049 151 2345 6789"],
        "meet me (at) noon. Then we go": [], "see you @ dinner. Bring bread": [],
        "card 4111  1111  1111  1112 it is": [], "on 2024-01-15 10:30 and 15.01.2024": [],
        "version 1.2.3 of 2024": [], "host 192[.]168[.]10[.]777 is up": [],
    }
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*planted, *plain])], "doc_id long, text string, __more string")
    found = {r["doc_id"]: r for r in pii.pii(docs).where(F.col("doc_id") < len(planted)).collect()}
    got = {t: [x["m"] for x in found[i]["pii_spans"] if x not in found[i]["pii_base"]] for i, t in enumerate(planted)}
    assert got == planted
    assert found[0]["__more"] == "clash"


def test_many_matches_in_one_text(spark, monkeypatch):
    from . import brute

    monkeypatch.setattr(pii, "train", lambda *a, **k: ("1D", [0.5] * 4))
    text = " ünd ".join(f"joe{i}@example.com or 10.0.{i % 250}.7 or bob{i} (at) host [dot] com" for i in range(700))
    r = pii.pii(spark.createDataFrame([(text,)], "text string")).withColumn("out", pii.redacted("text", "pii_spans")).first()
    kinds = [(pii.KINDS[x["kind"]], x["start"], x["end"]) for x in r["pii_spans"]]
    assert [k for k in kinds if k in set(brute.base_spans(text))] == brute.base_spans(text)
    assert len(kinds) == 2100 and all(text[s:e] == x["m"] for (_, s, e), x in zip(kinds, r["pii_spans"], strict=True))
    assert r["out"] == " ünd ".join(["[EMAIL] or [IP] or [EMAIL]"] * 700)


def test_rows_that_repeat_and_nulls(spark):
    rows = [(1, "a@b.co"), (1, "a@b.co"), (None, None), (None, "")]
    got = pii.pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "-", len(r["pii_spans"])) for r in got) == [("1", "a@b.co", 1), ("1", "a@b.co", 1), ("None", "-", 0), ("None", "-", 0)]
    assert pii.pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_table_of_one_make_teaches_other_makes(spark):
    """200 disguised spans and 200 decoys of varied make beside a table whose addresses and numbers are all alike."""
    rng = random.Random(77)
    r = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    few = lambda: str(rng.randrange(200, 999))

    def card(right):
        while True:
            d = rng.choice("3456") + r(15)
            total = sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(d)))
            if (total % 10 == 0) == right:
                return rng.choice(["  ", "--", ".", "- "]).join(d[i : i + 4] for i in range(0, 16, 4))

    users, hosts = ["bob.smith", "anna.kern", "maria", "li-wei", "peter_pan", "tom77", "hr"], ["mailbox.example.org", "example.com", "uni-bonn.de", "foo.co.uk", "acme.io", "corp.fr"]
    styles = [(" (at) ", " [dot] "), ("[at]", "[dot]"), ("(at)", "."), (" @ ", " . "), ("@", "[dot]"), (" at ", " dot "), ("{at}", "."), (" [AT] ", "[DOT]")]
    right = [(0, rng.choice(users) + at + rng.choice(hosts).replace(".", dot)) for at, dot in styles * 9][:70]
    right += [(1, rng.choice(["[.]", "(.)", "[dot]", " dot "]).join(str(rng.randrange(1, 256)) for _ in range(4))) for _ in range(40)]
    right += [(2, card(True)) for _ in range(40)]
    for _ in range(5):
        right += [(3, x) for x in (f"0049 30 {r(7)}", f"030-{r(4)}-{r(4)}", f"0044 20 {r(4)} {r(4)}", f"(415) {few()}-{r(4)}", f"001-{few()}-{few()}-{r(4)}", f"0151/{r(4)}{r(4)}", f"06 {r(2)} {r(2)} {r(2)} {r(2)}", f"0033 6 {r(2)} {r(2)} {r(2)} {r(2)}", f"415.{few()}.{r(4)}", f"1-{few()}-{few()}-{r(4)}")]
    word = lambda: rng.choice("noon dinner home office tea station bread river market".split())
    wrong = [x for _ in range(20) for x in (f"meet me (at) {word()}. Then {word()}", f"see you @ {word()}. Bring {word()}", f"{r(1)} kg @ {r(1)}.{r(2)} each")]
    wrong += [rng.choice(["[.]", "(.)"]).join([*(str(rng.randrange(1, 256)) for _ in range(3)), str(rng.randrange(256, 999))]) for _ in range(40)]
    wrong += [card(False) for _ in range(40)]
    wrong += [x for _ in range(12) for x in (f"2024-0{rng.randrange(1, 9)}-1{r(1)} 10:30", f"order {r(4)}-{r(4)}-{r(4)}", f"isbn 978-{rng.randrange(2, 9)}-{r(2)}-{r(6)}-{r(1)}", f"{rng.randrange(300, 999)}.{rng.randrange(300, 999)}.{r(3)}.{r(3)}", f"total {rng.randrange(2, 99)} {r(3)} {r(3)} {r(3)}")]
    assert len(right) == len(wrong) == 200
    around = ("{} now", "reach me: {} ok", "and {}, thanks", "the {} here")
    planted = [around[i % 4].format(x) for i, x in enumerate([*(x for _, x in right), *wrong])]
    alike = [f"text word.{i}@mail{i % 9}.example.com and +1 ({few()}) 555-{r(4)} or {i % 256}.7.8.{i % 99}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate([*planted, *alike])), "doc_id long, text string").repartition(8)
    found = {x["doc_id"]: [(s["kind"], s["m"]) for s in x["pii_spans"] if s not in x["pii_base"]] for x in pii.pii(docs).where("doc_id < 400").collect()}
    assert sum(x in found[i] for i, x in enumerate(right)) >= 180
    assert [(wrong[i], found[200 + i]) for i in range(200) if found[200 + i]] == []
