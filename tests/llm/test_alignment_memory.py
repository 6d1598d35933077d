"""A worker that goes from the tokenizers' step to the documents' step gives their memory back."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from corpusgrid.llm import token_alignment as ta
from corpusgrid.llm.common import gather
from corpusgrid.llm.word_tokens import vocabulary_path


def test_documents_step_drops_tokenizers_and_stretches():
    known = ta.stretches(vocabulary_path(ta.VOCABULARY_A), vocabulary_path(ta.VOCABULARY_B))
    rows = pa.table({"id": pa.array([7, 8], pa.int64()), "text": ["some words and some words", "a few more words"]}).to_batches()
    (ids, ends, body), = gather(iter(rows))
    block = ta.aligned_block(known, ids, ends, body)
    assert known.slot and ta._KNOWN
    pairs = block.pop("pairs")
    blocks = pa.table({k: [v] for k, v in block.items() if k != "documents"})
    answers = pa.table({"pos": np.arange(len(pairs)), "n": np.ones(len(pairs), np.int64), "best": np.ones(len(pairs), bool)})
    out = ta._documents(blocks, answers)
    assert out.num_rows == 2 and min(out.column("n_links").to_pylist()) > 0
    assert not ta._KNOWN


def test_blocks_hold_one_megabyte_of_text_and_row_groups_few_blocks(spark, monkeypatch):
    monkeypatch.setitem(ta.ROW_GROUPS, "parquet.block.size", "100000")
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(4000))) for i in range(200)], "doc_id long, text string").coalesce(1)
    blocks = ta.aligned_blocks(docs, vocabulary_path(ta.VOCABULARY_A), vocabulary_path(ta.VOCABULARY_B), "doc_id", "text")
    sizes = [len(r["ids"]) // 8 for r in blocks.select("ids").collect()]
    assert sum(sizes) == 200 and max(sizes) <= 40              # about 30 texts of 35 KB; a block took 2 MB of text
    groups = []
    for f in blocks.inputFiles():
        meta = pq.read_metadata("/" + f.removeprefix("file:").lstrip("/"))
        groups += [meta.row_group(k).num_rows for k in range(meta.num_row_groups)]
    assert sum(groups) == len(sizes) and max(groups) < len(sizes)      # all blocks of a task lay in one row group
