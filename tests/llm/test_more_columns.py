"""Extra columns named like anything that search, packing and infilling make."""

import public_tokenizers
import pytest
from test_columns import NAMES, table

from millrace.llm import infilling, packing, search

MORE = sorted({*NAMES, "id", "item", "item_id", "rank", "docs", "sizes", "heads", "packed", "rest", "full", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "form", "output", "output_sha256", "prefix_chars", "middle_chars", "made", "group", "term", "terms", "part"} - {"n", "form"})
PATH = public_tokenizers.path("word_bpe_49k.json")

OPERATORS = {
    "search": (lambda s, d: search.search(d, d.toDF(*["item_id" if c == "doc_id" else f"x_{c}" if c.lower() == "item_id" else c for c in d.columns])), None),
    "pack": (lambda s, d: packing.pack(d, PATH), set(packing.MADE)),
    "fill_in_middle": (lambda s, d: infilling.fill_in_middle(d), set(infilling.MADE)),
}


@pytest.mark.parametrize("operator", OPERATORS)
@pytest.mark.parametrize("upper", [False, True])
def test_operators(spark, operator, upper):
    docs = table(spark, [n.upper() if upper else n for n in MORE])
    work, made = OPERATORS[operator]
    out = work(spark, docs)
    rows = out.collect()
    assert len({c.lower() for c in out.columns}) == len(out.columns) and len(rows) >= 9
    if made is not None:
        whole = {r["doc_id"]: r.asDict() for r in docs.collect()}
        assert {r["doc_id"] for r in rows} == set(whole)
        assert all(r[c] == whole[r["doc_id"]][c] for r in rows for c in out.columns if c not in made and c in docs.columns and c.lower() not in made)
