"""The registered queries of the operators: SQL where there is some, whole tables, and the pipeline by brute force."""

import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from corpus_jobs.llm import byte_bpe, decontamination, packing, registry

from ..compare import connect, difference
from . import brute
from .conftest import SMALL
from .test_resemblance import all_pairs


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_is_sql(spark, name):
    assert difference(spark, connect(SMALL), registry.QUERIES[name], registry.ORACLE_SQL[name], SMALL) is None


def test_every_operator_is_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in registry.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"op4_benchmark_decontamination", "op7_nnls_packing", "op11_ranked_search", "op13_phrase_collocations"}))
def test_query_gives_a_row_for_every_document(spark, name):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = registry.QUERIES[name](spark, SMALL)
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


def test_units_are_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    e, library = byte_bpe.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    end = "<|endoftext|>"
    texts = [end, f"{end} at the start", f"in {end} the middle", f"at the end {end}", f"glued{end}to words", f"{end}{end} doubled {end} {end}\n{end}", "<|endoftext", "endoftext|>"]
    texts += ["".join(rng.choice(["a", " word", " ", "\n", "\t", "'s", "\x1c", end, ".", "é", "漢", "1"]) for _ in range(rng.randrange(12))) for _ in range(5000)]
    texts += ["".join(rng.choice("ab  \n\n.,'s12é漢\t|²́AΩ't'’\xa0\x1c\x85½") for _ in range(rng.randrange(40))) for _ in range(20000)]
    texts += ["It's l'école d'été.\n\nNext: 'quoted' \"x\" (y) - 3.5%\r\nend ", "don't 'tis .'tis 5's \n's"]
    want = [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert 50256 in want[0]
    assert [np.frombuffer(e.encode(t), "<u4").tolist() for t in texts] == want


def test_pipeline_is_brute_force(spark):
    """Each stage against its plain version, applied to what the stage before it kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r["item_id"], decontamination.normal(r["text"])) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SMALL)
        if name == "quality":
            hosts = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
            kept = brute.good([(t, hosts[d]) for d, t in rows.items()])
            rows = {d: t for (d, t), k in zip(rows.items(), kept) if k}
        elif name == "lines":
            keep = {}
            holders: dict[str, set] = {}
            key = lambda line: brute.ascii_lower(line.strip(" \t\n\v\f\r"))
            for d, t in rows.items():
                for line in t.split("\n"):
                    holders.setdefault(key(line), set()).add(d)
            for d, t in rows.items():
                keep[d] = "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or min(holders[key(x)]) == d)
            rows = keep
        elif name == "near_duplicates":
            rows = {d: rows[d] for d, c in all_pairs(list(rows.items())) if d == c}
        elif name == "decontaminate":
            whole = {d: decontamination.normal(t) for d, t in rows.items()}
            rows = {d: t for d, t in rows.items() if not any(i in whole[d] for _, i in bench)}
        if name != "pack":
            assert out.columns == docs.columns
            got = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}
            assert got == rows, name
    pieces = out.collect()
    n = {d: len(x) for d, x in zip(rows, brute.token_ids(rows.values(), packing.END_ID))}
    assert {p["doc_id"]: p["doc_tokens"] for p in pieces} == n
    assert sum(p["length"] for p in pieces) == sum(n.values())


def test_pipeline_leaves_its_last_table_only(spark, tmp_path):
    import os

    from corpus_jobs.storage import shared_dir

    at = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0
    new = set(os.listdir(at)) - before
    assert len(new) == 1 and all(x.startswith("stage-pack") for x in new)
