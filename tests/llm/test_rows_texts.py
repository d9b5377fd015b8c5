"""Garbled text, top rows, caps, token ids, mixing, reading level: brute force, exact round trips, held-out accuracy."""

import random
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.syllables import syllables
from millrace.llm import contributor_cap, garbled, mixing, reading_level, tokenizer, top_per_group
from tests.llm.syllable_words import WORDS

from millrace.operators import ranges

RANKS = Path(tokenizer.RANKS)
needs_ranks = pytest.mark.skipif(not RANKS.exists(), reason="no rank file")

CORRECT = ["Été à Noël — “ça va”", "MANHÃ E IRMÃ", "Отчёт показал рост", "Το νέο εργαλείο", "新模型今天发布，价格更低。", "├── src\n└── lib", "Łódź 25° £9 €5 µ Ω", "“ÉTÉ”", "plain", "ĐÃ SỬA", "¿Qué?", ""]


@pytest.mark.parametrize("text", CORRECT)
def test_correct_text_is_left_alone(text):
    assert garbled.restore(text) == (False, text)


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "mac_roman"])
@pytest.mark.parametrize("text", ["café", "Zürich — “quoted”", "công cụ dịch", "naïve", "Größe", "π≈3 …", "Новая модель", "翻訳ツール"])
def test_round_trip_of_a_piece(text, encoding):
    bad = garbled._read_as(text.encode(), encoding)
    assert garbled.restore(f"correct “text” {bad} é") == (True, f"correct “text” {text} é")


def test_twice_garbled_and_lossy():
    twice = garbled._read_as(garbled._read_as("naïve — ça".encode(), "cp1252").encode(), "cp1252")
    assert garbled.restore(twice) == (True, "naïve — ça")
    assert garbled.restore("a \x93quoted\x94 word") == (True, "a “quoted” word")
    assert garbled.restore("caf�") == (True, "caf�")
    long = "ok é " * 50_000 + "cafÃ©"
    assert garbled.restore(long) == (True, "ok é " * 50_000 + "café")


@pytest.mark.parametrize(
    "text,encoding",
    [("cœur", "cp1252"), ("đang", "cp1252"), ("nào", "cp1250"), ("à la", "cp1250"), ("Noël", "cp1250"), ("Noël", "cp1251"), ("août", "cp1251"), ("Änderung", "cp1250"), ("Österreich", "cp1250"), ("Ó", "cp1251"), ("À Évora", "cp1251")],
)
def test_one_ordinary_pair_alone(text, encoding):
    bad = garbled._read_as(text.encode(), encoding)
    assert garbled.restore(f"the word {bad} here") == (True, f"the word {text} here")


@pytest.mark.parametrize("text", ["Д’Артаньян и О’Нил", "В’ячеслав", "ODTÜ’den", "„CASĂ“ – MANHÃ", "ОПЕК… и «ДА»", "CAFÉ—bar", "«ÉTÉ»", "В\xa0доме OpenAI, О\xa0нас"])
def test_marks_after_capitals_in_correct_text(text):
    assert garbled.restore(text) == (False, text)


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "mac_roman"])
@pytest.mark.parametrize("text", ["العربية — “نموذج”", "שלום עולם", "नमस्ते दुनिया", "สวัสดี", "Բարեւ", "ქართული", "አማርኛ", "ខ្មែរ"])
def test_round_trip_of_further_scripts(text, encoding):
    bad = garbled._read_as(text.encode(), encoding)
    assert garbled.restore(f"correct {bad} end") == (True, f"correct {text} end")


@pytest.mark.parametrize("text", ["Шёлк и Щётка", "најљепши дан", "Фінляндія, Цікаво", "┌┐┌┐ █▓█▓", "3×“a” 4×—5", "ÚŽASNÝ", "العربية", "नमस्ते"])
def test_correct_text_beside_further_scripts(text):
    assert garbled.restore(text) == (False, text)


def test_garbled_fields(spark):
    df = spark.createDataFrame([(1, "cafÃ©", None, "x"), (2, None, "a “b”", "x"), (3, "", "â€™", "x"), (3, "", "â€™", "x")], "article_id long, title string, snippet string, field string")
    got = sorted(tuple(r) for r in garbled.garbled_fields(df).collect())
    assert got == [(1, "title", "cafÃ©", "café"), (3, "snippet", "â€™", "’"), (3, "snippet", "â€™", "’")]
    assert garbled.garbled_fields(df.where("false")).count() == 0


def test_top_rows_equal_a_window(spark):
    r = random.Random(1)
    data = [(i % 900, r.choice([None, 0, 0, 0, 1, 2]), r.choice(["a", "b", None]), r.choice([None, 1, 2, 3]), r.choice([None, 1, 2])) for i in range(3000)]
    df = spark.createDataFrame(data, "article_id long, batch_id long, category string, score int, priority int").repartition(7)
    groups = defaultdict(list)
    for a, b, c, s, p in data:
        if b is not None and c is not None:
            groups[b, c].append((s is None, -(s or 0), p is None, p or 0, a))
    want = sorted((*k, x[-1]) for k, v in groups.items() for x in sorted(v)[:3])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert sorted(tuple(x) for x in top_per_group.best_of_runs(df).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert top_per_group.best_of_runs(df.where("false")).count() == 0


def test_cap_equals_brute_force(spark):
    r = random.Random(3)
    data = [(i, r.choice(["Big", " big", "BIG ", "b i", "c", "d", None]), r.choice([None, 1, 2, 3]), "x") for i in range(2000)]
    data += data[:5]
    df = spark.createDataFrame(data, "article_id long, source string, score int, rank string").repartition(5)
    by = defaultdict(list)
    for i, s, sc, _ in data:
        if s is not None:
            by[" ".join(s.replace(" ", " ").split()).lower()].append((sc is None, -(sc or 0), i))
    cap = len(data) * 4 // 100
    want = sorted(x[-1] for v in by.values() for x in sorted(v)[cap:])
    assert sorted(x[0] for x in contributor_cap.over_share(df).collect()) == want
    assert contributor_cap.over_share(df, Fraction(1)).count() == 0
    assert contributor_cap.over_share(df.where("false")).count() == 0


def test_running_total(spark):
    df = spark.createDataFrame([(i, i * 7 % 13, i % 5) for i in range(500)], "id long, k int, v long").repartition(6)
    got = ranges.running_total(df, [F.col("k"), F.col("id")], "v").collect()
    total = 0
    for row in sorted(got, key=lambda x: (x.k, x.id)):
        assert row.before == total
        total += row.v


@needs_ranks
def test_ids_and_round_trip(spark):
    enc = tokenizer.encoding(tokenizer.RANKS)
    texts = ["", None, "Hello world", "<|endoftext|> is text", "  two  blanks \n\n\tend ", "naïve 🐝 公開", "x's don't we'll", "word " * 40_000, "a" * 150_000, " " * 120_000 + "x", "line\nline\n" * 20_000]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in tokenizer.corpus_ids(df.select("doc_id", "text")).collect()}
    assert got[0] == [] and got[1] is None and 50256 not in got[3]
    for i, t in enumerate(texts):
        if t is not None:
            assert enc.decode_bytes(got[i]).decode() == t
            if len(t) < 60_000 or i in (7, 10):
                assert got[i] == enc.encode_ordinary(t)
    back = spark.createDataFrame([(got[5],), (None,), ([],)], "ids array<int>").select(tokenizer.decoded(F.col("ids")).alias("t")).collect()
    assert [r.t for r in back] == [texts[5], None, ""]


def test_parts_end_where_a_piece_ends():
    text = "It's a test, isn't it?  yes\n\nno 12ab " * 300
    parts = tokenizer.split_long(text, 100)
    assert "".join(parts) == text and len(parts) > 50
    pieces = lambda s: tokenizer._PIECE.findall(s)
    assert [p for part in parts for p in pieces(part)] == pieces(text)


@needs_ranks
def test_mixture_keeps_shares_and_caps(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choices("alpha beta gamma delta epsilon".split(), k=r.randint(5, 60))), r.choices("abcx", [30, 5, 2, 9])[0]) for i in range(900)] + [(9000, None, "a"), (9001, "", "b"), (9002, "w", None)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, n int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, None), ("gone", 0.1, 2), (None, 0.1, 1), ("x", None, 1)], "source string, weight double, max_repeats int")
    rows = mixing.mixture(df, targets, slots=2000).collect()
    uses = {x.doc_id: x.uses for x in rows}
    caps = {"a": 1, "b": 4, "c": 1}
    assert all(1 <= x.uses <= caps[x.source] for x in rows) and {x.source for x in rows} == set(caps)
    total = sum(x.uses * x.n_tokens for x in rows)
    size = Counter()
    for x in rows:
        size[x.source] += x.uses * x.n_tokens
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(size[s] / total - w / 0.9) < 0.02
    assert {x.doc_id: x.uses for x in mixing.mixture(df.repartition(5), targets, slots=2000).collect()} == uses
    report = {x.source: x for x in mixing.shares(mixing.mixture(df, targets, slots=2000), targets).collect()}
    assert report["gone"].tokens == 0 and abs(sum(x.share for x in report.values()) - 1) < 1e-9
    half = mixing.mixture(df, targets, slots=2000, total=total // 2)
    assert abs(half.agg(F.sum(F.col("uses") * F.col("n_tokens"))).first()[0] - total // 2) < 0.03 * total
    short = {x.source: x.short for x in mixing.shares(half, targets, total).collect()}
    assert short["gone"] == -(-total // 10) and short["a"] > 0.2 * total
    assert mixing.mixture(df.where("false"), targets).count() == 0 and mixing.mixture(df, targets.where("false")).count() == 0


@pytest.mark.parametrize("true,read", garbled.SINGLE)
def test_single_byte_text_read_as_another(true, read):
    texts = ["Привет, это новости о моделях", "Новости: GPU стали дешевле на 5%", "Ελληνικά νέα για τη μηχανή", "مرحبا بالعالم الجديد", "שלום עולם חדשות היום", "ידיעות אחרונות: מודל חדש"]
    tried = 0
    for text in texts:
        try:
            wrong = text.encode(true).decode(read)
        except UnicodeError:
            continue
        if wrong != text:
            tried += 1
            assert garbled.restore(wrong) == (True, text)
    assert tried


@pytest.mark.parametrize("encoding", ["gbk", "cp932"])
def test_utf8_read_as_a_double_byte_encoding(encoding):
    texts = ["Привет, это новости о моделях!", "Zwölf große Bären à Paris", "Tôi yêu tiếng Việt", "日本語のニュース記事です", "שלום עולם חדשות", "Ελληνικά νέα για τη μηχανή"]
    tried = 0
    for text in texts:
        try:
            wrong = text.encode().decode(encoding)
        except UnicodeError:
            continue
        tried += 1
        assert garbled.restore(wrong) == (True, text)
    assert tried


@pytest.mark.parametrize("text", ["Привет, это новости о моделях", "중문 뉴스 제목입니다", "中文新闻标题联通公司发布新产品", "日本語のﾆｭｰｽ記事です", "iPhone手机 wifi没电了", "ÀÉÈ ÀÉÈ", "Ça et là, à Paris", "НАСА и ЕС", "Ελληνικά νέα", "שלום עולם", "مرحبا بالعالم"])
def test_correct_text_of_other_scripts(text):
    assert garbled.restore(text) == (False, text)


def test_text_garbled_many_times():
    text = wrong = "Ünïcödé café"
    for _ in range(9):
        wrong = wrong.encode().decode("latin-1")
    assert garbled.restore(wrong) == (True, text)


def test_syllables():
    wrong = [(w, n, syllables(w)) for n, words in WORDS.items() for w in words.split() if syllables(w) != n]
    assert not wrong and sum(len(w.split()) for w in WORDS.values()) > 350
    assert [syllables(w) for w in ("state-of-the-art", "x", "--", "naïve", "éclair", "software's")] == [4, 1, 1, 2, 2, 2]


def test_wrapped_sentences_are_whole():
    wrapped = "The team that made the first version of the tool\nwent on to write a second one, which was\nlater sold.\n\nA title that is long enough to be taken for a line\nThe next line is a sentence."
    assert reading_level.prose(wrapped) == ["The team that made the first version of the tool went on to write a second one, which was later sold.", "The next line is a sentence."]
    assert reading_level.statistics(wrapped)[0] == 2
    long_tag = f"<a href='{'x' * 900}'>The cat sat.</a> The dog ran."
    assert reading_level.statistics(long_tag)[1] == 6


def test_prose_only():
    text = "A title without an end\n\nThe cat sat. The dog ran!\nSELECT a, count(*) AS n\nFROM t\nfn main() {\n}\na\tb\t0.5\nRead more: https://x.example/a\n```\nThe code is here.\n```\nIt costs approx. $7.50, e.g. in the U.S. and v2.8.15 too."
    assert reading_level.prose(text) == ["The cat sat. The dog ran!", "It costs approx. $7.50, e.g. in the U.S. and v2.8.15 too."]
    st = reading_level.statistics(text)
    assert st[0] == 3
    assert reading_level.statistics("") is None and reading_level.statistics(None) is None and reading_level.statistics("no end") is None
    assert reading_level.median_grade("The cat sat on the mat. " * 20_000) < 3


def test_thresholds():
    g = np.array([1, 2, 3, 8, 9, 10, 20, 21, 22, 2.5])
    low, high = reading_level.fit_thresholds(g, np.array([1, 1, 1, 2, 2, 2, 3, 3, 3, 2]))
    assert 3 < low < 8 and 10 < high < 20
    assert reading_level.fit_thresholds(np.array([]), np.array([])) == reading_level.DEFAULT_THRESHOLDS


def test_levels(spark):
    easy, mid = "The cat sat. A dog ran. We like it. ", "The regular committee reported the director for the report and updated the local budget. The company expanded the service. "
    hard = "The computational infrastructure differentiated a heterogeneous generalization and necessitated interoperability. "
    data = [(1, easy * 5, "en", "article"), (2, mid * 5, "en", "analysis"), (3, hard * 5, "en", "abstract"), (4, easy, "fr", "article"), (5, easy, "en", "post"), (6, None, "en", "article"), (7, " ", "en", "article"), (8, easy, None, "article"), (9, easy, "en", None)]
    docs = spark.createDataFrame([(*d, 9) for d in data], "doc_id long, text string, lang string, doc_type string, level int")
    none = spark.createDataFrame([], "doc_id long, rater string, level int")
    assert sorted(tuple(r) for r in reading_level.reading_levels(docs, none).collect()) == [(1, 1), (2, 2), (3, 3)]
    assert reading_level.reading_levels(docs.where("false"), none).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test data")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_labels.parquet")
    graded = docs.join(labels.select("doc_id", F.col("level").alias("said")), "doc_id").select("doc_id", "said", reading_level.reading_grade(F.col("text")).alias("grade")).where("grade is not null").toPandas()
    fit, test = graded[graded.doc_id % 2 == 0], graded[graded.doc_id % 2 == 1]
    low, high = reading_level.fit_thresholds(fit.grade.to_numpy(), fit.said.to_numpy())
    got = np.where(test.grade <= low, 1, np.where(test.grade <= high, 2, 3))
    assert (got == test.said).mean() > 0.9
