"""Structure repair and centroid clustering against plain enumeration and plain loops."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderly.llm import clusters, registry, repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def plainly_cheapest(rows):
    """(cost, audit) by trying every string of edits; rows are (initial, fault)."""
    found = []

    def go(i, roles, cost, audit, inserted):
        if cost > 3 * len(rows):
            return
        if i == len(rows) and GRAMMAR.fullmatch(roles):
            found.append((cost, audit))
        if inserted < 2:
            for role in "ua":
                go(i, roles + role, cost + 2, audit + "I", inserted + 1)
        if i < len(rows):
            initial, fault = rows[i]
            extra = fault == repair.TRUNCATED
            go(i + 1, roles, cost + 3, audit + "D", 0)
            if fault not in (repair.BLANK, repair.DUPLICATE):
                go(i + 1, roles + initial, cost + extra, audit + "K", 0)
                for role in "ua":
                    go(i + 1, roles + role, cost + 2 + extra, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


@pytest.mark.parametrize("seed", range(40))
def test_integer_weights_find_the_cheapest_and_least_audit(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("suuaa-"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 4))]
    codes = bytes(repair.row_code(i, f) for i, f in rows)
    assert repair.cheapest(codes) == plainly_cheapest(rows)


def test_long_conversations_are_planned_whole():
    codes = bytes(repair.row_code("ua"[k % 2], repair.SOUND) for k in range(5_000))
    assert repair.cheapest(codes) == (0, "K" * 5_000)
    cost, audit = repair.cheapest(bytes(repair.row_code("u", repair.SOUND) for _ in range(301)))
    assert cost == 302 and len(audit.replace("I", "")) == 301


CONV = "conv_id long, turn long, role string, text string, kind string"


def damaged_plainly(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text, kind = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_query_on_messy_conversations(spark, tmp_path):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice(["A b.", "what?", "cut off", "\t\n", "", None, "A b."])) for c in [*range(60), None] for t in [None, *range(4)]]
    rows += [(0, 1, "user", "A b.")] * 3 + [(70, k, "user", "x" * 100_000 + ".") for k in range(30)]
    spark.createDataFrame([(*r, "clash") for r in rows], CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.asDict() for r in registry.queries()["op11_structure_repair"](spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    after = damaged_plainly(rows)
    for conv, row in got.items():
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.strip("\t\n\x0b\x0c\r ")
            faults.append(repair.BLANK if not bare else repair.DUPLICATE if (role, text) in seen else repair.TRUNCATED if bare[-1] not in ".!?" else repair.SOUND)
            seen.add((role, text))
        heads = [r[2][:1] for r in own]
        turns = {r[1] for r in own} - {None}
        assert row["gaps"] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        assert [row["blank"], row["duplicate"], row["truncated"]] == [faults.count(k) for k in (3, 2, 1)]
        assert row["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(heads))
        codes = bytes(repair.row_code(h if h and h in "sua" else "-", f) for h, f in zip(heads, faults, strict=True))
        if len(own) <= 5:
            assert (row["cost"], row["audit"]) == plainly_cheapest([(h, f) for h, f in zip(heads, faults, strict=True)])
        assert (row["cost"], row["audit"]) == repair.cheapest(codes)
        replay = repair.Replay(row["audit"])
        turns = [t for r in own for t in replay.row(r[2], r[3])] + list(replay.insertions())
        assert GRAMMAR.fullmatch("".join(t[0][0] for t in turns))
        assert row["repaired_sha256"] == hashlib.sha256("\n".join(":".join(t) for t in turns).encode()).hexdigest()


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Yes."), (2, 0, "system", "Be kind."), (2, 1, "user", "Hi!"), (3, 0, "user", " ")]
    turns = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "position").collect()
    assert [tuple(r) for r in turns] == [
        (1, 0, "user", "Hello."), (1, 1, "assistant", "Yes."), (2, 0, "system", "Be kind."), (2, 1, "user", "Hi!"), (2, 2, "assistant", ""),
    ]


VECTORS = "vec_id long, embedding array<float>, cluster string"


def clustered_plainly(rows):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    kept = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in kept[:16]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(3):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, k, d in last if k == c) for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, k, d, inertia[k], sum(inertia), digests[k]) for i, k, d in last]


@pytest.mark.parametrize("n", [0, 7, 120])
def test_clusters_against_plain_loops(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    rows = [(k, [float(x) for x in rng.normal(size=64).astype(np.float32)]) for k in range(n)]
    if n > 100:
        rows += [rows[3]] * 9 + [(None, rows[5][1]), (3, rows[6][1]), (200, None), (201, rows[0][1][:63]), (202, [None, *rows[0][1][1:]]), (203, [float("nan")] * 64), (204, [float("inf")] * 64), (205, [0.0] * 64)]
        rows += [(300, [3.0e7] * 64), (301, [-2.5e7] * 64)]  # beyond the 64-bit tables
    spark.createDataFrame([(i, v, "clash") for i, v in rows], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["op12_centroid_clustering"](spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    most = clusters.MOST
    expected = [(i, k, min(d, most), min(a, most), min(b, most), h) for i, k, d, a, b, h in clustered_plainly([(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows])]
    assert sorted([tuple(r) for r in got], key=key) == sorted(expected, key=key)


def test_general_interface_of_clusters(spark):
    rows = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 1.0]), ("c", [1.0, 0.9])], "name string, at array<double>").withColumn("v", F.lit(1))
    got = clusters.cluster(rows, "name", "at", dimensions=2, scale=10, k=2, rounds=5).collect()
    assert {r.name for r in got} == {"a", "b", "c"} and len({r.cluster for r in got}) == 2
