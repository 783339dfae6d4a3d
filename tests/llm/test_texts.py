"""Problems 3, 6, 7 and 8: personal information, token ids, leaked passages, shared spans."""

import os
import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest

from lorekeep.llm import leakage, sanitise, spans, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")
ODD = [
    None, "", " ", "\n\n  \n", "plain words", "don't we're 'll 'x", "a" * 700, "日本語のテキスト" * 40, "emoji 👩‍👩‍👧 and ​ zero\u0000", "<|endoftext|> text",
    "tabs\t\tand  many   blanks " * 30, "1234567890" * 30, "x=1;y=[2]" * 40, "é" * 301, "  mixed　blanks \u0085", "'" * 200, "r'e" * 150,
]


def texts(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(i, t, "x", "y", 1, b"k") for i, t in enumerate(rows)], "doc_id bigint, text string, ids string, part string, item_id int, key binary"
    )


@needs_vocabulary
@pytest.mark.parametrize("options", [{}, {"leaf_chars": 8, "part_chars": 64}, {"leaf_chars": 3, "part_chars": 17}])
def test_ids_equal_the_library(spark, options):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    rows = ODD + ["".join(rng.choice("ab '\n1.é🙂st") for _ in range(rng.randrange(200))) for _ in range(60)]
    theirs = Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    theirs.encode_special_tokens = True
    want = {i: theirs.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(rows)}
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(texts(spark, rows), **options).collect()}
    assert got == want
    assert all(tokens.decode(ids) == (rows[i] or "") for i, ids in got.items())


@needs_vocabulary
def test_ids_of_repeated_rows_and_none(spark):
    frame = texts(spark, ["same text " * 20])
    assert tokens.encode_corpus(frame.unionAll(frame), part_chars=50).count() == 2
    assert tokens.encode_corpus(frame.limit(0)).count() == 0


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen"), (2, "too short"), (3, None), (4, ""),
    (5, "ONE two three four five six seven eight nine ten eleven twelve"), (6, "Ångström ﬁne weather makes the old café sell more ices than any other day"),
    (6, "Ångström ﬁne weather makes the old café sell more ices than any other day"),
]
DOCS = [
    "x. One, two - three_four (five) six\nseven eight nine ten eleven twelve! end", "one two three four five six seven eight nine ten eleven",
    "one two three four five six seven eight nine ten eleven eleven twelve", None, "", "the Ångström fine weather​ makes the old café sell more ices than any day",
    "two three four five six seven eight nine ten eleven twelve thirteen", "word " * 5000,
]


def found(spark, docs, items, **options):
    frame = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id bigint, text string, doc_id string")
    return leakage.leaked_spans(texts(spark, docs), frame, **options)


@pytest.mark.parametrize("options", [{}, {"most_grams": 0}, {"most_broadcast_mb": -1}])
def test_leaks(spark, options):
    got = {(r["item_id"], r["doc_id"]) for r in found(spark, DOCS, ITEMS, **options).collect()}
    assert got == {(1, 0), (5, 0), (6, 5), (1, 6)}


def test_leaked_spans_are_removed(spark):
    docs = texts(spark, DOCS)
    left = {r["doc_id"]: (r["text"], r["n_removed"]) for r in leakage.without_leaks(docs, found(spark, DOCS, ITEMS)).collect()}
    assert left[0] == ("x.  end", len(DOCS[0]) - len("x.  end")) and left[6] == ("", len(DOCS[6])) and set(left) == {0, 5, 6}


def test_no_items_or_documents(spark):
    assert found(spark, DOCS, []).count() == 0 and found(spark, [], ITEMS).count() == 0


def test_words_against_categories():
    rng = random.Random(3)
    letters = "aB1²é́​_ -'Ⅳ日ß­ﬁ½ः"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(30))
        plain = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf").lower()
        want = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in plain).split()
        assert leakage.words(text) == want


def common(a, b, least):
    seen = {a[i : i + least] for i in range(len(a) - least + 1)}
    return any(b[i : i + least] in seen for i in range(len(b) - least + 1))


@pytest.mark.parametrize(
    ("least", "hot", "options"),
    [(240, 64, {}), (240, 1, {}), (40, 64, {"sample_least": 2}), (40, 2, {"sample_least": 3, "most_broadcast_rows": 0}), (5, 64, {}), (240, 64, {"sample_chars": 0}), (40, 1, {"sample_chars": 3000, "sample_least": 2})],
)
def test_shared_spans_against_brute_force(spark, least, hot, options):
    rng = random.Random(least)
    make = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    passages = [make(least + extra) for extra in (0, 1, least, 3 * least)] + [make(least - 1)]
    rows = [make(rng.randrange(3 * least)) + rng.choice([*passages, ""]) + make(rng.randrange(3 * least)) for _ in range(40)]
    rows += [None, "", "short", "=" * (2 * least), "-" + "=" * (least + 3), rows[0], rows[0], "日🙂" + passages[1]]
    want = {(i, j) for j in range(len(rows)) for i in range(j) if rows[i] and rows[j] and common(rows[i], rows[j], least)}
    shared = spans.SharedSpans(texts(spark, rows), least=least, hot=hot, **options)
    assert {tuple(r) for r in shared.record_pairs().collect()} == want
    covered = {r["doc_id"]: (r["n_chars"], r["n_shared"]) for r in shared.shares().collect()}
    windows = defaultdict(set)
    for i, t in enumerate(rows):
        for k in range(len(t or "") - least + 1):
            windows[t[k : k + least]].add(i)
    exact = {}
    for i, t in enumerate(rows):
        inside = np.zeros(len(t or ""), bool)
        for k in range(len(t or "") - least + 1):
            if len(windows[t[k : k + least]]) > 1:
                inside[k : k + least] = True
        if inside.any():
            exact[i] = (len(t), int(inside.sum()))
    assert covered == exact


def test_no_shared_spans(spark):
    assert spans.SharedSpans(texts(spark, [])).record_pairs().count() == 0
    assert spans.SharedSpans(texts(spark, [None, "", "x" * 500])).shares().count() == 0


def test_covers_and_hashes():
    for period, cover in spans.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    text = "abcab" * 50
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for width in (1, 2, 7, 108):
        h = spans.window_hashes(codes, width)
        groups = defaultdict(set)
        for i, x in enumerate(h):
            groups[x].add(text[i : i + width])
        assert len(h) == len(text) - width + 1 and all(len(g) == 1 for g in groups.values())
        assert len(groups) == len({text[i : i + width] for i in range(len(h))})


def test_anchors_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = "".join(random.Random(1).choice("abc") for _ in range(5000))
    whole = spans.anchors([text, "x" * 300, text], 240)
    monkeypatch.setattr(spans, "_PIECE", 700)
    parts = spans.anchors([text, "x" * 300, text], 240)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


FIRST, LAST = ["Anna", "Zoë", "Jean-Marc", "Peter"], ["Marbell", "Quen-Task", "Ostrand", "Velmark"]
PII = {
    "mail a.b+c@mail.example.org now": ["email"], "write to x_y at corp dot example dot org.": ["email"], "x(@)corp.example and y [at] corp [dot] example": ["email"] * 2,
    "meet at noon, tool@2.3.1 on root@build-07:/srv$ and @memoize": [], "call +44 7700 900269 or (212) 555-0119 ext. 12": ["phone"] * 2,
    "030/23125114, 01.99.00.58.13, 0033 1 99 00 82 83": ["phone"] * 3, "id=req-7700-900-x, ticket 2025-0612-77, mask 255.255.240.0, host 10.0.14.7": [],
    "build 20250411.0930, range 2024-11-03..2025-01-19, order 4415550199-A": [], "SSN 000-38-2224, QQ 82 25 43 L, 00005775-C, 06131363060": ["national_id"] * 4,
    "3 85 20 99 432 128 72 and X-0000095-M": ["national_id"] * 2, "at 177 Copperbeck Street, Thistleby TB10 4VV.": ["address"], "49 quarry gate st, thistleby": ["address"],
    "67, rue des Aulnes Gris, 00166 Montclairet": ["address"], "Am Alten Weg 9b, 00189 Ostheim": ["address"], "Lindenstr. 5, 00395 Ostheim": ["address"],
    "Plaza del Molino Blanco 30, 3º D, 00627 Puerto": ["address"], "P.O. Box 1333, Port Ellary VT 00090": ["address"],
    "see the Street View layer; Section 12, Main Road test data set": [], "Dr. A. Marbell met MARBELL Zoë, Velmark, Peter and peter k. ostrand": ["name"] * 4,
    "Thanks to Anna; the Peter Protocol; Marbell alone": [], "": [], "anna\nmarbell": ["name"],
    "write to " + "very.long_" * 40 + "x@mail.example.org": ["email"], "a%b%c@mail.example.org": ["email"],
}


@pytest.mark.parametrize("text", PII)
def test_mentions(text):
    given, family = ({w.lower() for w in words} for words in (FIRST, LAST))
    assert [k for _, _, k in sanitise.mentions(text, given, family)] == PII[text]


def notes(spark, rows):
    return spark.createDataFrame([("notes", str(i), "content", t, "x") for i, t in enumerate(rows)], "source string, id string, field string, text string, nth string")


def test_names_are_learned_from_the_corpus(spark):
    rng = random.Random(6)
    rows = [f"Ask {rng.choice(FIRST)} {rng.choice(LAST)} about the lock." for _ in range(300)] + ["The Anna Protocol draft is late."] * 20
    rows += ["nothing here at all, just words about the lock and the queue"] * 300 + [None, ""]
    labels = spark.createDataFrame([("name", "Anna Marbell"), ("name", "Ostrand, Peter"), ("name", "VELMARK Zoë"), ("name", None), ("none", None)], "kind string, mention string")
    s = sanitise.Sanitiser(notes(spark, rows), labels, least_partners=2)
    assert s.given == {w.lower() for w in FIRST} and s.family == {w.lower() for w in LAST}
    assert s.found().count() == 300
    first = s.replaced().where("id = '0'").first()
    assert first["text"] == "Ask [NAME] about the lock." and first["n_mentions"] == 1


def test_names_beside_one_partner_and_in_late_passes(spark):
    """A surname beside one given name only, a chain of names each known through the one before, and a product."""
    chain = {"Bela Aalto": 16, "Bela Bexley": 8, "Cora Bexley": 4, "Cora Corvin": 2}
    rows = ["ask Anna Zweigard about it", "The Anna Protocol draft is late."] * 30
    rows += [f"ask {name} about it" for name, n in chain.items() for _ in range(n)]
    rows += ["nothing here at all, just words about the lock and the queue"] * 300
    labels = spark.createDataFrame([("name", "Anna Aalto")], "kind string, mention string")
    s = sanitise.Sanitiser(notes(spark, rows), labels)
    assert s.given == {"anna", "bela", "cora"} and s.family == {"aalto", "zweigard", "bexley", "corvin"}
    assert s.found().count() == 30 + 30


def test_numbers_of_mentions_and_replacement(spark):
    rows = ["a@b.example, (212) 555-0119 and c@d.example", None, "", "no mention"]
    empty = spark.createDataFrame([], "kind string, mention string")
    s = sanitise.Sanitiser(notes(spark, rows), empty)
    assert {(r["id"], r["kind"], r["nth"]) for r in s.found().collect()} == {("0", "email", 1), ("0", "phone", 1), ("0", "email", 2)}
    assert {r["id"]: r["text"] for r in s.replaced().collect()} == {"0": "[EMAIL], [PHONE] and [EMAIL]", "3": "no mention"}
    assert sanitise.Sanitiser(notes(spark, []), empty).found().count() == 0


def test_labelled_sample(spark, folder):
    from lorekeep.llm.queries import _sanitiser
    from lorekeep.sources.tables import table

    labels = table(spark, folder, "pii_labels").collect()
    got = {tuple(r) for r in _sanitiser(spark, folder).found().select("source", "id", "field", "kind").distinct().collect()}
    want = {(r["source"], r["id"], r["field"], r["kind"]) for r in labels if r["kind"] not in ("none", "name")}
    fields = {(r["source"], r["id"], r["field"]) for r in labels}
    assert want <= got and {g for g in got if g[:3] in fields and g[3] != "name"} == want


def test_placeholders_are_typed():
    assert all(re.fullmatch("[a-z_]+", k) for k in sanitise.KINDS)


def test_boilerplate_in_a_third_of_all_records(spark):
    rng = random.Random(12)
    make = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    long, short = make(300), make(200)
    rows = [make(200) + (long if i % 3 == 0 else short if i % 3 == 1 else "") + make(200) for i in range(90)]
    shared = spans.SharedSpans(texts(spark, rows), hot=10)
    holders = set(range(0, 90, 3))
    assert {r["doc_id"] for r in shared.passages().collect()} == holders
    assert shared.window_sets.select("window").distinct().count() < 61 and shared.windows.count() == len(holders)
    assert {tuple(r) for r in shared.record_pairs().collect()} == {(a, b) for a in holders for b in holders if a < b}
    assert {r["doc_id"]: r["n_shared"] for r in shared.shares().collect()}.keys() == holders


def test_one_passage_in_very_many_records(spark):
    """4,000 texts share 2,000 characters: no bucket holds them, no pairs are made, and each text costs a few rows."""
    from pyspark.sql import functions as F

    passage = "".join(random.Random(3).choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2000))
    own = lambda seed: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.md5(F.concat_ws("-", "id", i, F.lit(seed)))), " ")
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat(own("a"), F.lit(passage), own("b")).alias("text"))
    shared = spans.SharedSpans(docs, sample_chars=1 << 20)
    assert shared.anchors.where("bucket >= 0").groupBy("bucket", "anchor").count().where("count > 64").count() == 0
    assert shared.extended.count() == 0 and shared.windows.count() == 4_000
    held = shared.passages()
    assert held.groupBy("passage").count().agg(F.max("count")).first()[0] == 4_000 and held.count() < 10 * 4_000
