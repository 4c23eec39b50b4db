"""The ring against a plain walk, and the pipeline against its stages."""

import random
import zlib

import corpus_pipeline
from trailmark.llm import sharding as R
from trailmark.llm._shared import written


def plain_walk(spark, counts, shards, vnodes):
    """counts by cell -> rows of (arc, lo, hi, shard), by walking the ring."""
    nodes = {r.cell: r.orders for r in R.ring(spark, shards, vnodes).collect()}
    spots = sorted(nodes)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    loads = {}
    for cell, n in counts.items():
        at = next((s for s in spots if s >= cell), spots[0])
        loads[at] = loads.get(at, 0) + n
    left = {}
    taken = {}
    for spot in spots:
        n, own = loads.get(spot, 0), nodes[spot][0]
        take = min(n, room[own])
        room[own] -= take
        taken[spot] = [(own, take)]
        left[spot] = n - take
    for spot in spots:
        for s in nodes[spot]:
            take = min(left[spot], room[s])
            if take:
                room[s] -= take
                left[spot] -= take
                taken[spot].append((s, take))
    assert not any(room)
    return sorted((s, n) for spot in spots for s, n in taken[spot] if n)


def test_ring_equals_a_plain_walk(spark):
    rng = random.Random(0)
    counts = {rng.randrange(R.CELLS): rng.randrange(1, 400) for _ in range(300)}
    table = spark.createDataFrame(sorted(counts.items()), "cell long, n long")
    pieces = R.plan(table, 7, 5)[1].collect()
    assert sorted((p.shard, p.hi - p.lo) for p in pieces) == plain_walk(spark, counts, 7, 5)


def test_shards_are_even_and_slots_gapless(docs_of, odd_rows):
    rng = random.Random(1)
    rows = odd_rows + [(rng.randrange(10**9), f"text {i % 9}") for i in range(500)] + [(77, "hot")] * 400
    got = R.shard(docs_of(rows), shards=24).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(rows) and sizes.max() - sizes.min() <= 1 and sorted(sizes.index) == list(range(24))
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    want = sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(zip(got.doc_id, got["size"], got.text_crc32, strict=True)) == want
    assert R.shard(docs_of([])).collect() == []


def test_few_rows_move_when_a_shard_is_added(docs_of):
    rows = [(i, "t") for i in range(4000)]
    a, b = ({r.doc_id: r.shard for r in R.shard(docs_of(rows), shards=n, vnodes=128).collect()} for n in (12, 13))
    assert sum(a[i] != b[i] for i in a) < 0.2 * len(rows)


def test_pipeline_is_its_stages(spark, docs_of, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(60)]
        if i % 5 == 1:
            w[7] = w[20] = rng.choice(["vile", "scum"])
        if i % 7 == 2:
            w = [x for x in w[:5] for _ in range(20)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 7 != 2), int(i % 5 == 1 and i % 7 != 2)))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 60, 5)]
    leak = " ".join(f"b{i}" for i in range(20))
    rows.append((2000, rows[3][1] + " " + leak))
    docs_of(rows).drop("score").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    everything = {i for i, _ in rows}
    toxic = {i for i, _, t in labels if t} | {1000 + i for i, _, t in labels if t and i % 5 == 0 and i < 60}
    poor = {i for i, q, _ in labels if not q}
    assert len((everything - ids[0]) ^ toxic) <= 8
    assert len(poor & ids[1]) <= 3 and len((ids[0] - poor) - ids[1]) <= 3
    assert not any(i >= 1000 and i < 2000 and i - 1000 in ids[1] and i in ids[2] for i in everything)
    assert 2000 in ids[2] and 2000 not in ids[3] and ids[4] == ids[3]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.select(run.columns).collect()))
