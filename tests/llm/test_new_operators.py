"""Sharding, fill-in-middle and importance resampling against brute force and SQL, and on odd input."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import fill_in_middle, importance, queries, sharding
from tests.llm.test_llm import ODD, docs, odd

# 11. sharding


def one_by_one(sizes, capacity):
    """Best fit of single groups, largest first, by looking at every open shard."""
    left, out = [], []
    for size in sizes:
        fit = [(rest, k) for k, rest in enumerate(left) if rest >= size]
        k = min(fit)[1] if fit else len(left)
        if not fit:
            left.append(capacity)
        left[k] -= size
        out.append(k)
    return out


def from_runs(runs):
    out = {}
    for _, first, groups, shard, each in runs:
        out |= {first + i: shard + i // each for i in range(groups)}
    return [out[i] for i in range(len(out))]


@pytest.mark.parametrize("seed", range(12))
def test_runs_are_best_fit_one_by_one(seed):
    r = random.Random(seed)
    sizes = sorted((r.choice([1, 2, 3, 7, 7, r.randint(1, 400), int(r.paretovariate(0.8))]) for _ in range(r.randint(1, 1500))), reverse=True)
    counted = sorted(Counter(sizes).items(), reverse=True)
    for capacity in (max(sizes), 50, sum(sizes) // 9 + 1):
        assert from_runs(sharding.packing(counted, capacity=capacity)) == one_by_one(sizes, capacity)
    shards = from_runs(sharding.packing(counted, 16))
    loads = Counter()
    for s, n in zip(shards, sizes):
        loads[s] += n
    assert set(shards) <= set(range(16)) and len(shards) == len(sizes)
    assert max(loads.values()) <= max(sizes[0], -(-sum(sizes) // 16) + sizes[0])


def test_tree_gives_the_tightest():
    r, tree, plain = random.Random(3), sharding.Capacities(), []
    for k in range(6000):
        if plain and r.random() < 0.3:
            least = r.randint(0, 1000)
            want = min((e for e in plain if e[0] >= least), default=None)
            assert tree.tightest(least) == want
            if want:
                plain.remove(want)
        else:
            plain.append((r.randint(1, 1000), k))
            tree.add(plain[-1])
    assert len(tree.leaves) > 1 and all(len(x) <= sharding.LEAF for x in tree.leaves)


def shards_of(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    return by


def test_shards_of_documents(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("ab é") for _ in range(r.randint(0, 300))) for _ in range(700)] + ["copy " * 40] * 150 + [None, "", "x" * 9000]
    rows = sharding.sharded(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    by_text = defaultdict(set)
    for x in rows:
        text = texts[x["doc_id"]] or ""
        assert (x["size"], x["text_crc32"], x["law"], x["grown_shard"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "bytes", None)
        by_text[text].add(x["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    loads = {k: sum(x["size"] for x in v) for k, v in shards_of(rows).items()}
    assert sorted(loads) == list(range(16))
    own = max(by_text["copy " * 40])
    rest = [n for k, n in loads.items() if k not in (own, *by_text["x" * 9000])]
    assert max(rest) - min(rest) <= 301  # apart from the two groups above an equal share, no more than one group
    for group in shards_of(rows).values():
        assert sorted(x["slot"] for x in group) == list(range(len(group)))


def test_fixed_capacity(spark):
    texts = [f"{k} " + "y" * (k % 50) for k in range(300)] + ["z" * 500]
    rows = sharding.sharded(docs(spark, texts), capacity=400).collect()
    sizes = sorted((len(t) + 1 for t in texts), reverse=True)
    loads = Counter()
    for x in rows:
        loads[x["shard"]] += x["size"]
    expected = Counter()
    for s, n in zip(one_by_one(sizes, 400), sizes):
        expected[s] += n
    assert sorted(loads.values()) == sorted(expected.values()) and max(loads.values()) == 501 and sorted(loads)[-1] == len(loads) - 1


def test_sharding_on_odd_rows(spark, tmp_path):
    rows = sharding.sharded(odd(spark).union(odd(spark))).collect()
    assert len(rows) == 2 * (len(ODD) + 1)
    for group in shards_of(rows).values():
        assert sorted(x["slot"] for x in group) == list(range(len(group)))
    assert sharding.sharded(odd(spark).limit(0)).isEmpty()
    assert sharding.sharded(docs(spark, ["only"])).select("shard", "slot").collect() == [(0, 0)]
    clash = odd(spark).withColumns({c: F.lit("c") for c in ("size", "copies", "position", "shard", "text_key", "doc")})
    sharding.write_shards(clash, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ODD) + 1 and back.where("size = 'c' and copies = 'c'").count() == len(ODD) + 1 and back.select("shard").distinct().count() <= 4


# 12. fill-in-middle

MARKED = ["a<P>b", "x\n<S>", "<M>", "<P", "S>\n<\nM>x", "one line", "\n", "\n\n\n", "a\r\nb c\x0bd\n", "\x1e\x1b\x1e", "a\x1bd\nb\x1bee\n\x1e\nc", "$1 \\ (x)\n$0\n", "\U0001f600\né\n" * 3, "end\nno newline"]


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return (n, "plain", None, None, sha(text), sha(text))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (n, form, len(p), len(m), sha(out), sha(text))


def test_fill_in_middle_by_hand(spark):
    r = random.Random(6)
    texts = ODD + MARKED * 4 + ["".join(r.choice(["a", "\n", "b c", "\x1e", "\x1b", "d", "e", "<", "P>", "é"]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    ids = [None if i == 5 else i * 7 for i in range(len(texts))]
    rows = {r["doc_id"]: tuple(r)[1:] for r in fill_in_middle.digests(docs(spark, texts, ids).withColumns({c: F.lit(1) for c in ("n", "form", "output", "_fim_low")})).collect()}
    assert rows == {i: by_hand(i, t) for i, t in zip(ids, texts)}


def test_fill_in_middle_keeps_columns_and_long_texts(spark):
    texts = ["x" * 2_000_000, "line\n" * 400_000, "\n" * 500_000, "y" * 1_000_000 + "\n" + "z" * 1_000_000]
    out = fill_in_middle.transformed(docs(spark, texts))
    assert {r["doc_id"]: tuple(r)[1:] for r in fill_in_middle.digests(docs(spark, texts)).collect()} == {i: by_hand(i, t) for i, t in enumerate(texts)}
    same = out.select("key", (F.concat("prefix", "middle", "suffix") == F.col("text")).alias("same")).collect()
    assert all(r["same"] and r["key"] == "k" for r in same)
    assert fill_in_middle.digests(odd(spark).limit(0)).isEmpty()
    assert {r["form"] for r in fill_in_middle.transformed(docs(spark, ["a\nb"] * 30), rate=0).collect()} == {"plain"}


def test_fill_in_middle_needs_no_shuffle(spark):
    assert "Exchange" not in fill_in_middle.digests(odd(spark))._jdf.queryExecution().executedPlan().toString()


# 13. importance resampling


def drawn_by_hand(texts, ids, target, percent=10, least=20, buckets=10_000, longest=1):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    grams = lambda w: [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    features = lambda t: [zlib.crc32(g.encode()) % buckets for g in grams(cut(t))]
    s, t = Counter(), Counter()
    for x in texts:
        s.update(features(x))
    for x in target:
        t.update(features(x))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, x in zip(ids, texts):
        f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(cut(x))])
    long_enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(long_enough[: len(long_enough) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("settings", [{}, {"longest": 3, "buckets": 97, "percent": 35, "least_words": 4}])
def test_importance_by_hand(spark, settings):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["Tim", "TIM", "été", "\U0001f600x", "a_b", "don't", "9z"]
    texts = ODD + [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(150)]
    texts += texts[20:50] + [texts[60]] * 40
    target = [" ".join(r.choice(vocabulary[:20]) for _ in range(30)) for _ in range(20)] + [None, ""]
    ids = [None if i == 3 else i for i in range(len(texts))]
    rows = importance.resampled(docs(spark, texts, ids), spark.createDataFrame([(t, 1) for t in target], "text string, copies int"), **settings).collect()
    by_hand_settings = {"least" if k == "least_words" else k: v for k, v in settings.items()}
    assert sorted((tuple(x) for x in rows), key=repr) == drawn_by_hand(texts, ids, target, **by_hand_settings)
    assert any(x["rank"] == 1 for x in rows)


def test_importance_on_odd_rows(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance.resampled(odd(spark).limit(0), target).isEmpty()
    rows = importance.resampled(odd(spark).union(odd(spark)), target.limit(0), percent=100, least_words=0).collect()
    assert len(rows) == 2 * (len(ODD) + 1) and sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))
    got = importance.drawn(odd(spark), target, percent=100, least_words=5)
    assert set(got.columns) == set(odd(spark).columns) and {r["doc_id"] for r in got.collect()} == {4, 5, 7}


# SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    d = duckdb.connect()
    for f in os.listdir(sf_dir):
        d.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    ours, theirs = queries.QUERIES[name](spark, sf_dir).toPandas(), d.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    whole = lambda v: None if v != v else int(v) if isinstance(v, float) and v == int(v) else v  # nullable integers come as floats
    rows = lambda x: sorted(repr([whole(v) for v in row]) for row in x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None))
    assert rows(ours) == rows(theirs)
