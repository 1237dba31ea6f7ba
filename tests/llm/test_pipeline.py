"""The pipeline's stages and the whole of it, against plain versions."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from test_dedup import plain_fingerprint
from test_tokens import library_ids, plain_verdict

from scholium.llm import common, mixing


def plain_stages(rows):
    """(doc_id, text, source) after the first three stages."""
    rows = [r for r in rows if not any(plain_verdict(r[1] or ""))]
    last = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        last[r[1]] = r
    rows = list(last.values())
    fps, root = [plain_fingerprint(r[1]) for r in rows], list(range(len(rows)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[of(i)] = of(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[of(i)].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_whole_pipeline(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = plain_stages([(r.doc_id, r.text, r.source) for r in docs.collect()])
    table = spark.createDataFrame(left, "doc_id long, text string, source string")
    copies = {r.doc_id: r.taken // max(r.size, 1) for r in mixing.mix(table).collect()}
    want = Counter()
    for doc_id, text, _ in left:
        x = library_ids(text)
        want[doc_id, len(x), hashlib.sha256(np.array(x, "<u4")).hexdigest(), tuple(x)] += copies[doc_id]
    got = corpus_pipeline.run(spark, sf_dir)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, tuple(r.ids)) for r in got.collect()) == +want


def test_stages_keep_columns_of_any_name(spark, odd, none, tmp_path):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (odd, none):
            got = stage(spark, df, None)
            assert got.columns == df.columns, name
            kept = {tuple(r) for r in got.collect()}
            assert kept <= {tuple(r) for r in df.collect()}, name
    assert corpus_pipeline.STAGES[-1][1](spark, none, None).count() == 0


def test_tables_of_a_run_are_dropped(spark):
    with common.run_folder(spark) as folder:
        df = common.written(spark.range(3), "some")
        assert df.count() == 3 and folder in df.inputFiles()[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
