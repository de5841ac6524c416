"""Canonical JSON, superseding records, votes and revisions against plain loops."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from tidemark.functions import canonical as C
from tidemark.operators import records as R


def test_canonical_json(spark):
    rows = [(1, 'a"b\\c\n\t\x01é ', 2.0, [1.5, None], {"z": 1, "a": None}, (True, None, "x")), (None, None, None, None, None, None), (-7, "", -0.0, [], {}, (None, 3, "\x1f\x7f"))]
    df = spark.createDataFrame(rows, "b long, a string, d double, e array<double>, m map<string,int>, s struct<y:boolean,x:int,w:string>")
    kind = df.schema
    got = [r[0] for r in df.select(C.json_of(F.struct(*df.columns), kind)).collect()]

    def plain(r):
        s = None if r[5] is None else dict(zip(("y", "x", "w"), r[5], strict=True))
        d = {"b": r[0], "a": r[1], "d": r[2] if r[2] is None else int(r[2]), "e": r[3], "m": r[4], "s": s}
        return json.dumps(d, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    assert got == [plain(r) for r in rows]
    own = df.select(C.json_of(F.col("s"), kind["s"].dataType, ordered=False).alias("s")).first()["s"]
    assert own == '{"y":true,"x":null,"w":"x"}'


def test_numbers_as_scripts_write_them(spark):
    wanted = {1.0: "1", 0.1: "0.1", 1e21: "1e+21", 1e20: "100000000000000000000", 123456.789: "123456.789", 1e-6: "0.000001", 1e-7: "1e-7", 1.5e-9: "1.5e-9", -2.5e300: "-2.5e+300", 12345678.9: "12345678.9", 1e7: "10000000", 0.0: "0", 1.7976931348623157e308: "1.7976931348623157e+308", 0.00012: "0.00012", 100.25: "100.25", 123e19: "1.23e+21", 0.30000000000000004: "0.30000000000000004"}
    got = spark.createDataFrame([(k,) for k in wanted], "x double").select("x", C.number(F.col("x")).alias("t")).collect()
    assert {r["x"]: r["t"] for r in got} == wanted
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(C.json_of(F.col("x"), spark.createDataFrame([], "x double").schema["x"].dataType)).collect()
    assert [r[0] for r in odd] == ["null"] * 3


def test_digests(spark):
    row = spark.createDataFrame([("map-é", 3, "map-é:span:0", "matched", "rough", "2024-01-01T00:00:00.000Z", 0, 10, 5, 15)], "m string, r int, s string, d string, p string, t string, a long, b long, c long, e long")
    text = json.dumps(["map-é", 3, "map-é:span:0", "matched", "rough", "2024-01-01T00:00:00.000Z", {"sourceStartMs": 0, "sourceEndMs": 10, "targetStartMs": 5, "targetEndMs": 15}], separators=(",", ":"), ensure_ascii=False)
    got = row.select(R.review_id(*[F.col(c) for c in row.columns]).alias("id"), R.reviewer_digest(F.lit(" ann ")).alias("who")).first()
    assert got["id"] == "alignment-review:" + hashlib.sha256(text.encode()).hexdigest()
    assert got["who"] == "sha256:" + hashlib.sha256(b"alignment-reviewer-v1:ann").hexdigest()


def test_superseding(spark):
    log = spark.createDataFrame([("r1", "m", 1, 10), ("r2", "m", 1, 20), ("r3", "m", 2, 15), ("r4", "m", 1, 30)], "id string, map string, span int, at int")
    got = {r["id"]: (r["supersedes"], r["state"]) for r in R.superseding(log, ["map", "span"], ["at"], "id").collect()}
    assert got == {"r1": (None, "superseded"), "r2": ("r1", "superseded"), "r4": ("r2", "active"), "r3": (None, "active")}
    assert {r["id"] for r in R.current(log, ["map", "span"], ["at"]).collect()} == {"r3", "r4"}


def test_votes(spark):
    records = spark.createDataFrame([("r", "active"), ("old", "superseded")], "record_id string, state string")
    votes = [
        ("r", "v0", "boss", "s", "adjudicator", "matched", None), ("r", "v1", "ann", "s", "independent", "matched", 10), ("r", "v2", "ann", "s", "independent", "sourceOnly", 10), ("r", "v3", "boss", "s", "adjudicator", "matched", None),
        ("r", "v4", "bob", "s", "independent", "unresolved", None), ("r", "v5", "boss", "s", "adjudicator", "matched", None), ("r", "v6", " bob ", "s", "independent", "matched", None), ("r", "v7", "bob", "s", "adjudicator", "matched", None),
        ("r", "v8", "boss", "s", "adjudicator", "matched", 0), ("r", "v9", "xy", "s", "independent", "matched", None), ("r", "w0", "carl", " ", "independent", "matched", None), ("r", "w1", "carl", "s", "independent", "matched", -1),
        ("old", "w2", "carl", "s", "independent", "matched", None), ("none", "w3", "carl", "s", "independent", "matched", None), ("r", "w4", None, "s", "independent", "matched", None),
    ]
    df = spark.createDataFrame([(*v, k) for k, v in enumerate(votes)], "record_id string, vote_id string, reviewer string, session string, role string, decision string, tolerance_ms int, at int").repartition(3)
    got = {r["vote_id"]: (r["fault"], r["supersedes"], r["state"]) for r in R.admitted_votes(records, df, ["at"]).collect()}
    assert got == {
        "v0": ("noConflict", None, None), "v1": (None, None, "superseded"), "v2": (None, "v1", "active"), "v3": ("noConflict", None, None), "v4": (None, None, "superseded"), "v5": ("noConflict", None, None), "v6": (None, "v4", "active"), "v7": ("sameReviewer", None, None),
        "v8": (None, None, "active"), "v9": ("reviewer", None, None), "w0": ("session", None, None), "w1": ("tolerance", None, None), "w2": ("record", None, None), "w3": ("record", None, None), "w4": ("reviewer", None, None),
    }


MUTATION = "project string, mutation_id string, request_hash string, expected_head bigint, kind string, source_revision bigint, snapshot string, at int"


def mutations(rng, n):
    out, head = [], {"p": 1, "q": 4}
    for k in range(n):
        p = rng.choice(["p", "q", "none"])
        if out and rng.random() < 0.25:
            m = list(rng.choice(out))
            m[2] = rng.choice([m[2], m[2], "other"])
            out.append((*m[:7], k))
            continue
        kind = rng.choice(["autosave", "checkpoint", "rollback", "other"] if rng.random() < 0.3 else ["autosave"])
        expected = head.get(p, 1) + rng.choice([0, 0, 0, 1, -1])
        out.append((p, f"m{k}", f"h{k}", expected, kind, rng.choice([None, 1]) if kind != "autosave" else None, f"snapshot {k}", k))
        if p in head and expected == head[p] and kind in ("autosave", "checkpoint") and out[-1][5] is None or kind == "rollback" and out[-1][5] and p in head and expected == head[p]:
            head[p] += 1
    return out


def plain(heads, rows):
    heads, receipts, out = dict(heads), {}, []
    for p, m, h, expected, kind, source, snapshot, _ in rows:
        bad = kind not in ("autosave", "checkpoint", "rollback") or (kind == "rollback") != (source is not None)
        head = heads.get(p)
        if bad:
            out.append((p, m, "invalid", None, head))
        elif (p, m) in receipts:
            out.append((p, m, "replayed", receipts[p, m][1], head) if receipts[p, m][0] == h else (p, m, "mismatch", None, head))
        elif head is None:
            out.append((p, m, "unknown", None, None))
        elif expected != head:
            out.append((p, m, "conflict", None, head))
        else:
            heads[p] = head + 1
            receipts[p, m] = (h, head + 1, snapshot)
            out.append((p, m, "committed", head + 1, head + 1))
    return out, heads, receipts


def test_revisions(spark, tmp_path):
    rows = mutations(random.Random(7), 120)
    heads = spark.createDataFrame([("p", 1), ("q", 4)], "project string, head bigint")
    want, after, receipts = plain({"p": 1, "q": 4}, rows)
    got = R.commits(heads, spark.createDataFrame(rows, MUTATION).repartition(4), ["at"]).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert {x[2] for x in want} == {"committed", "replayed", "mismatch", "unknown", "conflict", "invalid"}

    path = str(tmp_path / "revisions")
    spark.createDataFrame([("p", "first", "h", 0, "autosave", None, "start", -1, 1), ("q", "first", "h", 3, "autosave", None, "start", -1, 4)], f"{MUTATION}, revision bigint").select("project", "revision", "mutation_id", "request_hash", "kind", "source_revision", "snapshot", "at").write.parquet(path)
    for part in (rows[:50], rows[50:], rows[50:]):
        out = R.commit_snapshots(path, spark.createDataFrame(part, MUTATION), ["at"])
    assert out.filter("status = 'committed'").count() == 0 and out.filter("status = 'replayed'").count() > 0
    held = spark.read.parquet(path)
    assert {r["project"]: r["revision"] for r in R.current(held, ["project"], ["revision"]).collect()} == after
    assert {(r["project"], r["mutation_id"]): (r["request_hash"], r["revision"], r["snapshot"]) for r in held.filter("at >= 0").collect()} == receipts
