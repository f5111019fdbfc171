import numpy as np

import corpus_pipeline as P
from tests.llm.test_near_dup import brute as near
from tests.llm.test_quality import brute as figures
from tests.llm.test_tokens import check_packing
from tokenloom.llm import mixing
from tokenloom.llm.common import written


def test_stages_on_their_own_inputs(spark, sf_dir, docs, rows, labels):
    kept, stages = {}, dict(P.STAGES)
    now = docs
    for name, stage in P.STAGES[:-1]:
        now = written(stage(spark, now, sf_dir), f"test-{name}")
        assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
        kept[name] = [r["doc_id"] for r in now.collect()]
        assert all(r["text"] == rows[r["doc_id"]]["text"] for r in now.collect())
    assert list(stages) == ["quality_rules", "language_id", "near_dedup", "mix_sources", "pack"]
    good = set(kept["quality_rules"])
    assert all(not figures(rows[d]["text"])["base_failed"] for d in good)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    clean = [d for d in rows if quality.get(d) == 1 and not figures(rows[d]["text"])["base_failed"]]
    assert len(set(clean) & good) >= 0.97 * len(clean)
    known = set(kept["language_id"])
    assert known <= good and len(known) >= 0.97 * len(good)
    verdict = near({d: rows[d]["text"] for d in known})
    assert sorted(kept["near_dedup"]) == sorted(d for d in known if verdict[d][2])
    before = docs.where(docs["doc_id"].isin(kept["near_dedup"]))
    assert sorted(kept["mix_sources"]) == sorted(r["doc_id"] for r in mixing.mixture(before).collect())
    pieces = stages["pack"](spark, now, sf_dir).collect()
    copies = {d: int(n) for d, n in zip(*np.unique(kept["mix_sources"], return_counts=True))}
    check_packing(pieces, {d: (rows[d]["text"], n) for d, n in copies.items()})


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_registered():
    import __spark_entry__ as E

    names = [n for n in E.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()
