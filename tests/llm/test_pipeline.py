import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from marginalia.llm.quality import classify_quality
from marginalia.llm.toxicity import classify_toxicity

from tests.llm.test_classifiers import insult, junk, prose
from tests.llm.test_parity_join import brute


def test_stages_equal_a_plain_version(spark, tmp_path):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(700):
        text, good, toxic = prose(r, r.randint(30, 90)), 1, 0
        kind = r.random()
        if rows and kind < 0.15:
            text = r.choice(rows)[1] + r.choice(["", " more"])
        elif kind < 0.35:
            text, good = junk(r, text), 0
        elif kind < 0.55:
            text, toxic = insult(r, text), 1
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        if kind >= 0.15:
            labels.append((i, good, toxic))
    rows += [(900, None, None, None, None), (901, "", "en", "src0", 0), (None, "stone of the river", "en", "src1", 18), (902, rows[40][1], "en", "src1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, table = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]

    good = {x.doc_id for x in classify_quality(docs, table).collect() if x.predicted}
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == good and len(good) < len(rows)
    clean = {x.doc_id for x in classify_toxicity(kept, table).collect() if not x.predicted}
    rest = corpus_pipeline.toxicity(spark, kept, str(tmp_path))
    assert rest.columns == docs.columns and {x.doc_id for x in rest.collect()} == clean and clean < good
    left = [(x.doc_id, x.text) for x in rest.collect()]
    alone = {k for k, _, c in brute(left) if c is None or k == str(c)}
    single = corpus_pipeline.near_duplicates(spark, rest, str(tmp_path))
    assert single.columns == docs.columns and {str(x.doc_id) for x in single.collect()} == alone and len(alone) < len(left)

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {str(x.doc_id) for x in out} == alone
    model = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    texts = {str(i): t for i, t, *_ in rows}
    for x in out:
        ids = model.encode(texts[str(x.doc_id)] or "", add_special_tokens=False).ids + [0]
        assert (x.piece, x.start, x.length) == (0, 0, len(ids)) and x.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    ends = {}
    for x in sorted(out, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == ends.get(x.sequence_id, 0)
        ends[x.sequence_id] = x.offset + x.length
    assert max(ends.values()) <= 2048


def test_one_of_repeated_keys_stays(spark):
    from marginalia.llm.parity_join import keep_one_of_each

    rows = [(1, "a b"), (1, "a b"), (2, "c d"), (None, "a b"), (None, "a b"), (3, "a b"), (4, None), (4, "")]
    got = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(x.doc_id) for x in got) == ["1", "2", "4", "None", "None"]
    assert keep_one_of_each(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
