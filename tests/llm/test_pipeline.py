"""The language stage's decisions, and the whole pipeline against plain Python."""

import hashlib
import random
import zlib

import pytest

import corpus_pipeline
from rankloom.llm.mixing import Mixing, calibrate
from rankloom.llm.queries import PIECE_MODEL

KINDS = {"en": "the of and ing tion er th wh", "de": "der und sch ung ei zu ver ch", "fr": "le de que eau oux ment ai", "es": "el que ción ado ar os ll"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
N = 400
SECRET = "0123456789abcdef0123"


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source, n_chars) and what the language stage makes of lang; None: it goes."""
    rng, out = random.Random(1), []
    for i in range(N):
        lang = list(KINDS)[i % 4]
        out.append((" ".join("".join(rng.choices(KINDS[lang].split(), k=rng.randint(1, 3))) for _ in range(40)), lang, lang))
    out[8] = (out[8][0] + f" password={SECRET} ", "en", "en")
    out[13] = (out[13][0], None, "de")
    wrong = next(i for i in range(2, N, 4) if zlib.crc32(str(i).encode()) % 4 == 2)
    out[wrong] = (out[wrong][0], "de", "fr")
    out += [(out[20][0], "en", "en"), ("12 34 !", "en", None), (None, "en", None), ("сегодня хорошая погода и мы идём гулять в парк", None, None)]
    return [((i, t, lang, f"s{i % 3}", len(t or "")), want) for i, (t, lang, want) in enumerate(out)]


def test_the_prediction_decides(spark, rows):
    docs = spark.createDataFrame([r for r, _ in rows], SCHEMA)
    kept = {r.doc_id: r.lang for r in corpus_pipeline.by_language(spark, docs, "").collect()}
    assert kept == {r[0]: want for r, want in rows if want}


def test_the_pipeline_equals_plain_python(spark, rows, tmp_path):
    import sentencepiece

    spark.createDataFrame([r for r, _ in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = [(i, t.replace(SECRET, "[secret]"), want, s) for (i, t, _, s, _), want in rows if want and i != N]
    cells = {}
    for _, t, lang, source in docs:
        cells[source, lang, "prose"] = cells.get((source, lang, "prose"), 0.0) + len(t.split())
    weights, share = calibrate(list(cells.items()), Mixing())
    draw = lambda i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:12], 16) / 2**48
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    wanted = {i: library.encode(t) for i, t, lang, source in docs if draw(i) < weights[source, lang, "prose"] * share}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == wanted and len(wanted) > 20


def test_rows_that_are_not_drawn_go(spark):
    """Rows without an id, with one id, and with one id and text in several cells: the stage keeps what the draw keeps."""
    from rankloom.llm.mixing import mix

    rows = [(None, f"text number {i} with words", "en", "s", 1) for i in range(40)]
    rows += [(7, f"other text {i} of one id", "en", "s", 1) for i in range(20)]
    rows += [(8, "one text", lang, source, 1) for lang in ("en", "de", None) for source in ("s", "t", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = [(r.doc_id, r.key_a, r.source, r.lang) for r in mix(docs).filter("kept").collect()]
    found = corpus_pipeline.mixed(spark, docs, "")
    assert found.count() == len(kept) < len(rows)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_of_empty_and_odd_tables(spark, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), "").collect() == []
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c d e f g", None, None, None), (2, "word " * 9000, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, Text string, KEY_A int".replace("Text string", "key string"))
    found = stage(spark, docs, "")
    assert len(found.collect()) <= len(rows) and "KEY_A" not in found.columns
