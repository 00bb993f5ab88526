"""Text rules on hand-made rows."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from commentlab.functions import labels as lb
from commentlab.functions import lexicons as lx
from commentlab.functions import text as tx


def run(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, t {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_aggressive_clean(spark):
    rows = [None, "", "Cek https://a.b/c?d=1 @budi #tag 😂 123 abc123", "lihat www.x.y ya", "한국어 かな ok",
            "a b c", "@www.foo bar", "Jokowi IJAZAHNYA!!"]
    assert run(spark, rows, tx.clean_aggressive("t")) == [
        "", "", "cek abc", "lihat ya", "ok", "a b c", "bar", "jokowi ijazahnya"]


def test_minimal_clean(spark):
    rows = [None, "Cek https://a.b/c?d=1 @budi #tag 😂 123 abc123", "한국어 かな ok", "Jokowi ijazahnya palsu bgt sih",
            "é & ü (x-y) 'q' \"z\"; a_b"]
    assert run(spark, rows, tx.clean_minimal("t")) == [
        "", "cek tag 123 abc123", "ok", "jokowi ijazahnya palsu bgt sih", "é ü (x-y) 'q' \"z\"; a_b"]


def test_strict_emoji_keeps_other_scripts(spark):
    assert run(spark, ["한국어 😂 ok"], tx.clean_minimal("t", lx.EMOJI_RANGES_STRICT)) == ["한국어 ok"]


def test_clean_is_stable(spark):
    rows = ["A @b #c https://d e9f 😂 g", "x  y\n\tz", "#a@b @#a"]
    once = run(spark, rows, tx.clean_aggressive("t"))
    assert run(spark, once, tx.clean_aggressive("t")) == once


def test_feature_text(spark):
    rows = ["gw bikin konten mantep bgt", "makasih bang", "xD", "g", "buat apa", "kaya raya", "tidak setuju"]
    assert run(spark, rows, tx.feature_text("t")) == [
        "buat konten mantap", "terima kasih", "", "tidak", "", "kaya raya", "tidak setuju"]


def test_slang_two_words_and_deletion(spark):
    assert run(spark, ["makasih bang ok", "sih deh"], tx.normalize_slang("t")) == ["terima kasih oke", ""]


def test_tokens_and_stopwords(spark):
    assert run(spark, ["  a  yang bb ", "", None], tx.tokens("t")) == [["a", "yang", "bb"], [], []]
    assert run(spark, ["a yang bb tidak"], tx.drop_stopwords(tx.tokens("t"))) == [["bb", "tidak"]]


def test_readable(spark):
    rows = ["Mantap", "HOAX", "😂😂😂", "❤", "Suwardi ❤😂🎉", "ab", "", None, "abc 123456"]
    assert run(spark, rows, tx.is_readable("t")) == [True, True, False, False, True, False, False, False, False]


def test_light_normalization_and_candidates(spark):
    rows = ["a​b  c", "!!! ??? ...", "satu dua", "satu dua tiga", None]
    assert run(spark, rows, tx.normalize_light("t")) == ["a b c", "!!! ??? ...", "satu dua", "satu dua tiga", ""]
    assert run(spark, rows, tx.is_candidate("t")) == [True, False, False, True, False]


def test_word_count(spark):
    rows = ["", "  ", "a", " a  b\n c ", "a b", None]
    assert run(spark, rows, tx.word_count("t")) == [0, 0, 1, 3, 2, 0]


def test_ngrams(spark):
    words = F.split("t", " ")
    assert run(spark, ["a b c", "a"], tx.word_ngrams(words, 3)) == [["a", "b", "c", "a b", "b c", "a b c"], ["a"]]


def plain_char_ngrams(words, lo=3, hi=5):
    out = []
    for w in words:
        w = f" {w} "
        for n in range(lo, hi + 1):
            if n > lo and len(w) < n:
                break
            out += [w[i:i + n] for i in range(max(len(w) - n + 1, 1))]
    return out


def test_char_ngrams(spark):
    rows = ["a", "ab abc", "halo dunia"]
    got = run(spark, rows, tx.char_ngrams(F.split("t", " ")))
    assert [sorted(g) for g in got] == [sorted(plain_char_ngrams(r.split())) for r in rows]
    assert run(spark, [""], tx.char_ngrams(tx.tokens("t"))) == [[]]
    assert run(spark, ["a"], tx.char_ngrams(F.split("t", " "), 5, 6)) == [[" a "]]


def test_negation_merge(spark):
    rows = ["tidak palsu", "tidak tidak palsu", "ini bukan", "halo dunia", "x tidak a tidak b", ""]
    assert run(spark, rows, tx.merge_negation("t")) == [
        "tidak_palsu", "tidak_tidak palsu", "ini bukan", "halo dunia", "x tidak_a tidak_b", ""]


def plain_negation(text):
    words, out, i = text.split(), [], 0
    while i < len(words):
        pair = words[i] in lx.NEGATORS and i + 1 < len(words)
        out.append("_".join(words[i:i + 2]) if pair else words[i])
        i += 2 if pair else 1
    return " ".join(out)


@settings(max_examples=5, deadline=None)
@given(hs.lists(hs.lists(hs.sampled_from(["tidak", "ga", "x", "palsu", "bukan"]), max_size=9).map(" ".join), min_size=20, max_size=60))
def test_negation_merge_against_loop(spark, rows):
    assert run(spark, rows, tx.merge_negation("t")) == [plain_negation(r) for r in rows]


def test_domain_flags(spark):
    rows = ["Roy itu HOAX", "jokowi tidak asli", "royal"]
    flags = tx.domain_flags("t")
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(*[c.alias(n) for n, c in flags.items()])
    full = df.select("*", *[c.alias(n) for n, c in tx.flag_interactions().items()])
    got = [{k for k, v in r.asDict().items() if v} for r in full.collect()]
    assert got == [{"accuser", "slander", "accuser_slander"}, {"subject", "negator", "genuine", "verdict_genuine"}, set()]
    assert len(full.columns) == 13


def test_preview_and_keyword(spark):
    assert run(spark, ["x" * 170, "y" * 171, None], tx.preview("t")) == ["x" * 170, "y" * 170 + "...", ""]
    assert run(spark, ["a.b", "AxB", "c("], tx.matches_keyword("t", "a.b")) == [True, True, False]
    assert run(spark, ["a.b", "AxB", "c("], tx.matches_keyword("t", "C(", literal=True)) == [False, False, True]


def test_labels(spark):
    rows = [" Positive", "NEG", "netral ", "maybe", "", None]
    assert run(spark, rows, lb.canonical_label("t")) == ["Positif", "Negatif", "Netral", None, None, None]
    assert run(spark, ["Negatif", "Positif", "x"], lb.label_id("t")) == [0, 2, None]
    assert run(spark, [" positif ", "NETRAL"], lb.strict_label("t")) == ["Positif", "Netral"]
    with pytest.raises(Exception, match="unknown label"):
        run(spark, ["positive"], lb.strict_label("t"))


def test_tolerant_bool(spark):
    rows = ["true", "1", "yes", "y", "benar", "false", "0", "no", "n", "salah", "", None, "maybe", " TRUE "]
    want = [True] * 5 + [False] * 5 + [None] * 3 + [True]
    assert run(spark, rows, lb.tolerant_bool("t")) == want
    short = run(spark, rows, lb.tolerant_bool("t", lx.TRUE_WORDS_SHORT, lx.FALSE_WORDS_SHORT))
    assert short[3] is None and short[8] is None


def test_safe_int_and_confidence(spark):
    assert run(spark, ["12", None, "x", "4.2", " 7 "], lb.safe_int("t")) == [12, 0, 0, 0, 7]
    assert run(spark, ["0.5", None, "x"], lb.sortable_confidence("t")) == [0.5, -1.0, -1.0]


def test_link_ids(spark):
    i = "dQw4w9WgXcQ"
    rows = [f"https://www.youtube.com/watch?v={i}", f"https://www.youtube.com/watch?a=1&v={i}&t=2", f"https://youtu.be/{i}",
            f"https://youtube.com/embed/{i}", f" https://youtube.com/shorts/{i} ", f"https://youtube.com/v/{i}",
            "https://example.com/x", "", None, "https://youtu.be/short"]
    got = run(spark, rows, lb.extract_id("t"))
    assert got == [i] * 6 + [None] * 4
    assert run(spark, [i, "bad", None, i + "x"], lb.is_valid_id("t")) == [True, False, False, False]


def test_response_class(spark):
    df = spark.createDataFrame(
        [(403, ["x", "quotaExceeded"]), (403, ["dailyLimitExceeded"]), (403, ["forbidden"]), (403, None), (500, None), (200, None)],
        "s int, r array<string>")
    got = [r[0] for r in df.select(lb.response_class("s", "r")).collect()]
    assert got == ["quota", "quota", "forbidden", "forbidden", "error", "ok"]


def test_agreement_band(spark):
    rows = [-0.1, 0.0, 0.19, 0.2, 0.4, 0.6, 0.8, 1.0]
    assert run(spark, rows, lb.agreement_band("t"), "double") == [
        "poor (lebih buruk dari acak)", "slight", "slight", "fair", "moderate", "substantial", "almost perfect", "almost perfect"]


@settings(max_examples=5, deadline=None)
@given(hs.lists(hs.text(alphabet="aZ 1é@#_. \nあ😂-'", max_size=25), min_size=20, max_size=60))
def test_cleaning_against_plain_python(spark, rows):
    emoji = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in lx.EMOJI_RANGES) + "]+"

    def aggressive(t):
        t = re.sub(r"https?://\S+|www\.\S+", " ", t.lower())
        t = re.sub(r"#\w+", " ", re.sub(r"@\w+", " ", t))
        t = re.sub(r"[^a-z\s]", " ", re.sub(r"\b\d+\b", " ", re.sub(emoji, " ", t)))
        return " ".join(t.split())

    def minimal(t):
        t = re.sub(r"@\w+", " ", re.sub(r"https?://\S+|www\.\S+", " ", t.lower()))
        t = re.sub(r"[^\w\s.,!?;:'\"()-]", " ", re.sub(emoji, " ", t))
        return " ".join(t.split())

    assert run(spark, rows, tx.clean_aggressive("t")) == [aggressive(r) for r in rows]
    assert run(spark, rows, tx.clean_minimal("t")) == [minimal(r) for r in rows]
    assert run(spark, rows, tx.word_count("t")) == [len(r.split()) for r in rows]


def test_white_space_at_the_ends(spark):
    spaced = ["Positif\n", "\tneg ", " Netral　", None, " x y "]
    assert run(spark, spaced, lb.canonical_label("t")) == ["Positif", "Negatif", "Netral", None, None]
    assert run(spark, spaced, tx.strip("t")) == ["Positif", "neg", "Netral", None, "x y"]
    assert run(spark, ["\t\n", " ", "", None, " a"], tx.is_blank("t")) == [True, True, True, True, False]
    assert run(spark, ["3000000000", "7\n", "4.0", "1e3"], lb.safe_int("t")) == [3000000000, 7, 0, 0]


def test_flags_search_only_texts_with_a_word(spark):
    """Lists of plain words get a cheap test first; other patterns, and word ends, are as before."""
    assert tx.plain_words(r"\broy\b|pria solo") == ["roy", "pria solo"] and tx.plain_words(r"\b(tidak|gak)\b") == ["tidak", "gak"]
    assert tx.plain_words(r"a.c|b") == tx.plain_words(r"(a|b)c") == tx.plain_words(r"\ba\w|b") == tx.plain_words("a|") == []
    patterns = {"ends": r"\broy\b|solo", "group": r"\b(gak|tak)\b", "dots": r"a.c|zz", "empty": "x|"}
    texts = ["Roy", "royal", "SOLO", "gak", "gaky \u00e9gak", "tak.", "abc", "", None, "\u00e9roy roy\u0301"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = [F.lower(F.coalesce("t", F.lit(""))).rlike(f"(?U){p}").cast("int").alias(f"want_{n}") for n, p in patterns.items()]
    for r in df.select("t", *plain, *[c.alias(n) for n, c in tx.domain_flags("t", patterns).items()]).collect():
        assert [r[n] for n in patterns] == [r[f"want_{n}"] for n in patterns], r["t"]


def test_repeated_steps_run_once(spark):
    """Counting words and minimal cleaning name their cleaned text several times and compute it once."""
    df = spark.createDataFrame([("a",)], "t string")
    for column in (tx.word_count("t"), tx.clean_minimal("t")):
        plan = df.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("coalesce(") == 1, plan


def test_terms_are_counted_in_their_row(spark):
    """Counts per document, also of rows that share a key, null or empty arrays; nothing is moved by key or term."""
    from commentlab.operators.features import term_counts

    rows = [(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["a"]), (4, ["a", "c"]), (5, ["x"] * 9 + ["", "é"])]
    df = spark.createDataFrame(rows, "id int, words array<string>")
    got = sorted(map(tuple, term_counts(df, "id", "words").collect()))
    assert got == [(1, "a", 1), (1, "b", 2), (4, "a", 2), (4, "c", 1), (5, "", 1), (5, "x", 9), (5, "é", 1)]
    single = term_counts(df.filter("id <> 4"), "id", "words")
    assert [f.dataType.simpleString() for f in single.schema.fields] == ["int", "string", "bigint"]
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
