"""The pipeline against a plain version of its stages, and the entry with and without this part."""

import re
import subprocess
import sys

import corpus_pipeline
from oddone.llm import langid, secret_scan
from oddone.llm.common import table

from .test_dedup import plain_join
from .test_texts import check_packed


def test_pipeline_against_plain_stages(spark, tokenizer_ids):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    judge = langid.Classifier(langid.learn(docs))
    rows = {i: t for i, t in rows.items() if (lambda x: x[0] != "und" and x[1] >= langid.MIN_MARGIN)(judge(t))}
    assert len(rows) > 0.95 * docs.count()
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]), i)
    rows = {i: rows[i] for i in first.values()}
    rows = {i: rows[i] for i, head, _ in plain_join(list(rows.items())) if i == head}
    found = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs).collect()}
    for i in rows:
        for _, a, b in sorted((s.split(":") for s in found[i].split(",") if s), key=lambda s: -int(s[1])):
            if not any(int(x.split(":")[1]) < int(a) < int(x.split(":")[2]) for x in found[i].split(",")):
                over = max(int(x.split(":")[2]) for x in found[i].split(",") if int(a) <= int(x.split(":")[1]) <= int(b))
                rows[i] = rows[i][:int(a)] + "[redacted]" + rows[i][max(int(b), over):]
    packed = corpus_pipeline.run(spark, sf).collect()
    check_packed(packed, {i: tokenizer_ids(t) for i, t in rows.items()})


def test_stages_keep_the_columns(spark, odd):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, "")
        assert out.schema.names == odd.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
        assert out.count() <= odd.count()
        assert stage(spark, odd.limit(0), "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), "").count() == 0


def test_entry_registers_the_part():
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' in q and sum(n.startswith('op') for n in q) == 10"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rpartition("/")[0])
