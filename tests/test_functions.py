from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.functions.dates import date_range
from lorekeep.functions.keys import norm_id, store_path
from lorekeep.functions.times import instant_micros, month_of_micros
from lorekeep.operators.keyword import Query


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_slugs(spark):
    cases = {
        "Hello World": "hello-world.md", "foo@bar#baz!": "foo-bar-baz.md", "": "untitled.md", None: "untitled.md", "a" * 150: "a" * 100 + ".md",
        "a---b": "a-b.md", "word   with   spaces": "word-with-spaces.md", "***": "untitled.md", "Grüße": "gr-e.md", "-x-": "x.md",
    }
    assert column(spark, list(cases), text.slug_name) == list(cases.values())


def test_instants(spark):
    utc = lambda *a: int((datetime(*a) - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    cases = {
        "1719794022": 1719794022 * 10**6, "-5": -5 * 10**6, "2024-07-01T03:42:55Z": utc(2024, 7, 1, 3, 42, 55),
        "2024-07-01 03:42:55": utc(2024, 7, 1, 3, 42, 55), "2024-07-01T03:42:55+02:00": utc(2024, 7, 1, 1, 42, 55),
        "2024-07-01T03:42:55.250Z": utc(2024, 7, 1, 3, 42, 55, 250000), " 2024-07-01T03:42:55-05:00 ": utc(2024, 7, 1, 8, 42, 55),
        "2024-02-30T00:00:00Z": None, "0000-00-00T00:00:00Z": None, "yesterday": None, "": None, None: None, "2024-07-01": None,
        "12.5": None, "999999999999999999": None, "99999999999999999999999": None,
    }
    assert column(spark, list(cases), instant_micros) == list(cases.values())
    assert column(spark, [utc(2024, 12, 31, 23, 59), -1, None], month_of_micros, "bigint") == ["2024-12", "1969-12", None]


def test_ids_and_paths(spark):
    assert column(spark, [" AbC ", "", "  ", None, "x\t"], norm_id) == ["abc", None, None, None, "x"]
    same = "notes/a/b.md"
    cases = {
        same: same, "./notes/a/b.md": same, "notes//a/b.md": same, "notes\\a\\b.md": same, "/srv/memstore/notes/a/b.md": same,
        "notes/tmp/../a/b.md": same, "notes/./a/b.md": same, "../memstore/notes/a/b.md": same, "Notes/a/b.md": "Notes/a/b.md",
        "/srv/memstore//./notes/a/b.md": same, "/etc/x": "/etc/x", "": None, None: None, "/srv/memstore": None, "../../..": "/",
    }
    assert column(spark, list(cases), store_path) == list(cases.values())


def test_title_words_and_overlap(spark, one):
    words = lambda t: set(column(spark, [t], text.title_words)[0])
    assert words("The Quick Brown Fox") == {"quick", "brown", "fox"}
    assert words("") == set() and words(None) == set()
    assert words("A B CD EFG") == {"efg"}
    assert words("Design and Build for Production with Docker") == {"design", "build", "production", "docker"}
    assert words("é éé") == {"éé"}  # lengths are bytes: é has two
    overlap = lambda a, b: one(text.word_overlap, a=a, b=b)
    assert overlap(["api", "rest", "oauth"], ["api", "rest", "oauth"]) == 1.0
    assert overlap(["api", "rest", "oauth", "token"], ["api", "rest", "json", "xml"]) == 0.5
    assert overlap(["a"], ["b"]) == 0.0


def test_terms(spark):
    assert column(spark, ["The API, api_v2 é x!"], text.terms) == [["api", "api", "v2", "é"]]
    assert column(spark, ["", None], text.terms) == [[], None]


def test_search_form(spark):
    assert column(spark, ["Café dev-ops", None, "多路复用器 x"], text.search_form) == [" cafe dev ops ", "  ", " 多路复用器 x "]
    assert column(spark, [" cafe dev ops ", "  "], text.n_words) == [3, 0]


def test_previews_and_sizes(spark):
    assert column(spark, ["x" * 150], text.preview) == ["x" * 100 + "..."]
    assert column(spark, ["a\nb"], text.context_preview) == ["a b"]
    assert column(spark, ["x" * 61], text.note_preview) == ["x" * 57 + "..."]
    assert column(spark, [10, 2048, 3 << 20], text.human_bytes, "bigint") == ["10 B", "2.0 KB", "3.0 MB"]
    long = "word " * 2000
    cut = column(spark, [long], text.embedding_input)[0]
    assert len(cut) <= 7500 and cut.endswith("word") and column(spark, ["short"], text.embedding_input) == ["short"]


def test_recency(spark, one):
    now = datetime(2025, 7, 1)
    boosted = lambda days: one(lambda s, c, a: text.recency_boosted(s, c, a), s=1.0, c=now - timedelta(days), a=now)
    assert boosted(1) == pytest.approx(1.2) and boosted(31) == 1.0 and boosted(18.5) == pytest.approx(1.1) and boosted(-3) == pytest.approx(1.2)


def test_languages_secrets_backends(spark, one):
    assert column(spark, ["a/B.GO", "x.tsx", "y.rs", "z.txt", "noext"], text.language_of) == ["go", "typescript", "rust", "", ""]
    assert column(spark, ["openai_api_key", "x.api_key_env", "Password", "limit"], text.is_secret) == [True, False, True, False]
    assert column(spark, ["abcdefghij", "short"], text.masked) == ["abcd...ghij", "***"]
    pairs = column(spark, ["a:b:c", "a", "", None], text.backend_pair)
    assert [tuple(p) for p in pairs] == [("a", "b:c"), ("a", "a"), ("tfidf", "tfidf"), ("tfidf", "tfidf")]


def test_observation(spark):
    kept = column(spark, ["short error", "x" * 30, "line one is fine\n  1 test FAILED here \nok", "error " * 500], text.observation)
    assert kept == ["", "", "1 test FAILED here", ""]


def test_date_range():
    today = date(2025, 3, 1)
    assert date_range("today", today) == ("2025-03-01", "2025-03-01")
    assert date_range("yesterday", today) == ("2025-02-28", "2025-02-28")
    assert date_range("week", today) == date_range("7d", today) == ("2025-02-22", "2025-03-01")
    assert date_range("month", today) == date_range("30d", today) == ("2025-01-30", "2025-03-01")
    assert date_range("2025-01-01..2025-02-01", today) == ("2025-01-01", "2025-02-01") and date_range("..x", today) == (None, "x")
    with pytest.raises(ValueError):
        date_range("soon", today)


@pytest.mark.parametrize(
    ("words", "groups", "excluded"),
    [
        ("simple", [["simple"]], []), ("two words", [["two", "words"]], []), ("dev-ops", [["dev ops"]], []), ('"row group" x', [["row group", "x"]], []),
        ("a OR b c", [["a"], ["b", "c"]], []), ("a AND b", [["a", "b"]], []), ("a NOT b", [["a"]], ["b"]), ("orch*", [["orch*"]], []),
        ("dev-orch*", [["dev orch*"]], []), ("prefix:value", [["prefix value"]], []), ("(grouped)", [["grouped"]], []), ("x OR", [["x"]], []),
    ],
)
def test_query_parse(words, groups, excluded):
    q = Query.parse(words)
    assert (q.groups, q.excluded) == (groups, excluded)


@pytest.mark.parametrize("words", ["", "  ", "NOT x", "--"])
def test_query_without_word(words):
    with pytest.raises(ValueError):
        Query.parse(words)
