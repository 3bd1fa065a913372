"""Repeated passages in scripts without blanks."""

from rankloom.llm.substring_dedup import repeated_spans


def test_repeated_passages_without_blanks(spark):
    chinese = "这是一个用来测试重复段落的长句子，它没有空格。"
    thai = "นี่คือประโยคยาวที่ซ้ำกัน"
    own = "另外一句完全不同的话也在这里出现！"
    texts = [chinese, own + chinese + "短句。短句。", "a\n" + thai, thai + "\nb", "𠀀" * 12, "x 𠀀" + "𠀀" * 11 + "\n" + "𠀀" * 12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_units, [texts[r.doc_id][s.start : s.stop] for s in r.removed]) for r in repeated_spans(docs).collect()}
    assert found == {0: (1, []), 1: (2, [chinese]), 2: (1, []), 3: (1, [thai]), 4: (1, []), 5: (2, ["𠀀" * 12])}
