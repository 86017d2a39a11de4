"""Operators 11 to 13 and their queries, column by column, against brute-force versions and DuckDB."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from listwright.llm import infill, whiten

SEEDS = ["", "<", "<P", "<S>", "<P>", "a<M>b", "é漢字 🎉", "ab", "AſKb", "\n\t ", "x" * 50, "@[`{AZaz"]


def texts(rng, n=300):
    out = [None, *SEEDS, "word " * 30000]
    out += ["".join(rng.choice(SEEDS + ["word", " ", "more ", "1.5", "<", ">"]) for _ in range(rng.randint(1, 40))) for _ in range(n)]
    return out


def rounded(rows):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.fixture
def table(spark, tmp_path):
    """Writes rows as a table of a new folder; gives the folder, and DuckDB's rows for an SQL text over it."""
    spark_rows = {}

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        spark_rows[name] = f"{tmp_path}/{name}.parquet"

    def duck(sql, columns):
        con = duckdb.connect()
        for name, path in spark_rows.items():
            con.execute(f"create view {name} as select * from read_parquet('{path}/*.parquet')")
        return con.execute(f"select {', '.join(columns)} from ({sql})").fetchall()

    write.duck, write.folder = duck, str(tmp_path)
    return write


DOCS = "doc_id long, text string, lang string, source string, n_chars long, n string, form string, c0 string"


def documents(values):
    rows = [(i, t, None, "s", 1, "clash", "clash", "clash") for i, t in enumerate(values)]
    return rows + [(5, values[5], None, None, None, None, None, None), (None, values[20], None, None, None, None, None, None)]


def infilled(doc_id, text):
    """By the definition, with a regular expression."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h[3] % 100 < 20 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), "spm" if h[3] % 100 < 20 else "psm", len(prefix), len(middle), out


def test_infill_query(spark, table):
    rows = documents(texts(random.Random(1)))
    table("documents", rows, DOCS)
    out = infill.op13_infill(spark, table.folder)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(r[0], *(x := infilled(r[0], r[1]))[:4], sha(x[4]), sha(r[1] or "")) for r in rows]
    got = [tuple(r) for r in out.collect()]
    assert rounded(got) == rounded(want)
    assert rounded(table.duck(infill.OP13_SQL, out.columns)) == rounded(want)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_infill_keeps_other_columns(spark):
    rows = documents(texts(random.Random(2), 50))
    out = infill.fill_in_middle(spark.createDataFrame(rows, DOCS))
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "n", "form", "c0", "prefix_chars", "middle_chars", "output"}
    got = out.withColumn("back", infill.original(F.col("output"), F.col("form"))).collect()
    assert all(r.back == (r.text or "") for r in got)
    assert sorted((r.doc_id or -1, r.output) for r in got) == sorted((r[0] or -1, infilled(r[0], r[1])[4]) for r in rows)
    assert infill.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, id string, x string"


def vectors(rng, n, width, rank=None):
    mixed = rng.standard_normal((rank or width, width)) * np.linspace(1, 0.2, rank or width)[:, None]
    return (rng.standard_normal((n, rank or width)) @ mixed * 0.2).astype(np.float32).tolist()


def brute_whitened(rows, k=16):
    """(x by row, centred whitened up to sign, eigenvalues, trace, n, S) with a full eigendecomposition."""
    kept = [r for r in rows if r[1] is not None and all(e is not None and np.isfinite(e) for e in r[1])]
    width = max(len(r[1]) for r in kept)
    x = [tuple(int(np.floor(64 * np.float64(np.float32(e)))) + 1000000 for e in r[1]) + (1000000,) * (width - len(r[1])) for r in kept]
    distinct = sorted(set(x))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centre = lambda v: np.array([float(a - s // n) - (s % n) / n for a, s in zip(v, sums)])
    c = np.array([centre(v) for v in distinct])
    v = c.T @ c / n
    values, inner = np.linalg.eigh(v)
    values, inner = values[::-1][:k], inner[:, ::-1][:, :k]
    return kept, x, n, sums, values, np.trace(v), np.array([centre(v) for v in x]) @ inner / np.sqrt(np.maximum(values, 1e-300))


@pytest.mark.parametrize("width,n,rank", [(64, 400, None), (24, 300, 9), (3, 50, None), (200, 150, None)])
def test_whitening_query(spark, table, width, n, rank):
    rng = np.random.default_rng(width)
    found = vectors(rng, n, width, rank)
    found += found[:20] * 2  # copies
    rows = [(i, v, 1, "clash", "clash") for i, v in enumerate(found)]
    rows += [(7, found[3], 1, None, None), (None, found[4], 1, None, None), (9001, None, 1, None, None), (9002, [float("nan")] * width, 1, None, None)]
    rows += [(9003, [float("inf")] + found[0][1:], 1, None, None), (9004, [None] + found[0][1:], 1, None, None)]
    if rank is None:
        rows.append((9005, found[1][: width - 1], 1, None, None))  # a shorter vector
    table("embeddings", rows, VECTORS)
    got = whiten.op11_whitening(spark, table.folder).collect()
    kept, x, total, sums, values, trace, w = brute_whitened(rows)
    some = int((values > 1e-9 * values[0]).sum())
    assert len(got) == len(kept) * some
    key = lambda i: -1 if i is None else i
    deviation = [sum((total * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    want = {c: sorted((key(r[0]), d, abs(p[c])) for r, d, p in zip(kept, deviation, w)) for c in range(some)}
    for c in range(some):
        mine = sorted((key(r.vec_id), r.deviation, abs(r.whitened)) for r in got if r.component == c + 1)
        assert [m[:2] for m in mine] == [t[:2] for t in want[c]]
        gap = min(abs(values[c] - values[o]) for o in range(len(values)) if o != c) / values[0]
        assert np.abs(np.array([m[2] for m in mine]) - [t[2] for t in want[c]]).max() < 1e-10 / gap
    assert {r.n for r in got} == {total} and max(r.identity_error for r in got) < 1e-8
    for r in got:
        assert abs(r.explained - values[r.component - 1] / trace) < 1e-9


def test_whitening_edges(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, 0, "", "") for i, v in enumerate(rows)], VECTORS)
    assert whiten.whitened(frame([])).count() == 0
    assert whiten.whitened(frame([[1.0, 2.0]] * 3)).count() == 0  # no variance
    assert whiten.whitened(frame([[], []])).count() == 0
    out = whiten.whitened(frame([[0.0, 0.0], [1.0, 1.0], [1.0, 1.0], [3e38, 0.0]])).collect()  # two distinct vectors: one direction
    assert [(r.id, r.component, r.n) for r in sorted(out)] == [(i, 1, 2) for i in range(3)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == pytest.approx(1) and r.deviation == 2 * 64 * 64 for r in out)
    large = whiten.whitened(frame([[2.0**40], [-(2.0**40)], [0.0]])).collect()
    assert sorted((r.id, r.deviation) for r in large if r.id == 2) == [(2, 0)] and {r.deviation for r in large if r.id != 2} == {None}


def test_lanczos_finds_repeated_eigenvalues():
    rng = np.random.default_rng(5)
    for values in ([9.0] * 5 + [4.0] * 20 + [1.0] * 15, [3.0] * 2 + [0.0] * 38, list(np.geomspace(1e6, 1e-3, 40))):
        q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
        m = (q * np.array(values)) @ q.T
        calls = []
        found, vectors_ = whiten.lanczos(lambda b: calls.append(b) or m @ b, 40, 6)
        assert np.allclose(found, values[:6], rtol=1e-9, atol=1e-9)
        assert np.abs(m @ vectors_ - vectors_ * found).max() < 1e-9 * values[0] and np.allclose(vectors_.T @ vectors_, np.eye(6), atol=1e-12)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}


def components_of(texts_, percent=80):
    """Smallest index reachable by links, for each text, from all pairs."""
    sets, root = [grams(t) for t in texts_], list(range(len(texts_)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and root[i] != root[j] and 100 * len(a & b) >= percent * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return [len(s) for s in sets], root


def near_copies(rng, copies=160):
    """Families of texts with a few changed words, chains, texts about a shared passage, short ones, copies and empty ones."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    prose = lambda n: [word() for _ in range(n)]
    out = [None, "", " \n", "one", "ONE", "one two three", "a b " * 60, "b a " * 60]
    passage = prose(60)
    for size in (5, 6, 30, 120, 400, 3000):
        base = prose(size)
        for _ in range(copies // 8 if size < 3000 else 8):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 60))):
                w[rng.randrange(size)] = word()
            out.append(" ".join(w))
    out += [" ".join([*prose(rng.randint(3, 25)), *passage, *prose(rng.randint(3, 25))]) for _ in range(copies // 2)]
    chain = prose(200)
    for _ in range(copies // 4):  # each is near the one before
        at = rng.randrange(190)
        chain = chain[:at] + prose(3) + chain[at + 3 :]
        out.append(" ".join(chain))
    return out + out[10:40]


@pytest.mark.parametrize("block", [512, 7])
def test_ngram_join_query(spark, table, monkeypatch, block):
    from listwright.llm import prefix_join

    monkeypatch.setattr(prefix_join, "BLOCK", block)  # a small one, so that cells split
    values = near_copies(random.Random(block))
    order = list(range(len(values)))
    random.Random(2).shuffle(order)
    rows = [(i, values[i], None, "s", 1, "clash", "clash", "clash") for i in order]
    table("documents", rows, DOCS)
    out = prefix_join.op12_ngram_join(spark, table.folder)
    n, root = components_of(values)
    want = [(i, n[i], root[i]) for i in range(len(values))]
    assert rounded(tuple(r) for r in out.collect()) == rounded(want)
    assert rounded(table.duck(prefix_join.OP12_SQL, out.columns)) == rounded(want)


def test_ngram_join_rows(spark):
    from listwright.llm import prefix_join

    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text, None, None, 1, "x", "y", "z"), (3, text, None, None, 1, "x", "y", "z"), (3, "other words", None, None, 1, "x", "y", "z"), (None, text + " end", None, None, 1, "x", "y", "z"), (None, None, None, None, 1, "x", "y", "z")]
    out = prefix_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert rounded((r.id, r.n, r.component) for r in out) == rounded([(3, 46, 3), (3, 46, 3), (3, 1, 3), (None, 47, 3), (None, 0, None)])
    assert prefix_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_tree_finds_the_components_of_a_cell(percent):
    from listwright.llm.prefix_join import _Tree

    rng = random.Random(percent)
    for _ in range(60):
        base = rng.sample(range(1000), rng.randint(1, 40))
        sets = []
        for _ in range(rng.randint(2, 30)):
            keep = [x for x in base if rng.random() > rng.choice([0, 0.02, 0.1, 0.4])] + rng.sample(range(1000, 1200), rng.choice([0, 0, 1, 3, 9]))
            sets.append(np.array(sorted(set(keep)) or [5], np.uint64))
        side = np.array([rng.choice([0, 1]) for _ in sets]) if rng.random() < 0.5 else np.full(len(sets), -1)
        root = np.arange(len(sets))
        want = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if (side[i] != side[j] or side[i] < 0) and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    want = [min(want[i], want[j]) if w in (want[i], want[j]) else w for w in want]
        found = _Tree(sets, side, root, percent).links()
        got = list(range(len(sets)))
        for i, j in found:
            got = [min(got[i], got[j]) if g in (got[i], got[j]) else g for g in got]
        assert got == want and len(found) == len(sets) - len(set(want))


@pytest.mark.parametrize("percent", [40, 80, 95])
def test_signatures_lose_no_link(percent):
    from listwright.llm.prefix_join import _possible, _signature

    rng = np.random.default_rng(percent)
    dropped = 0
    for _ in range(40):
        base = rng.integers(0, 2**63, rng.integers(1, 700), dtype=np.uint64)
        sets = []
        for _ in range(rng.integers(2, 40)):
            keep = base[rng.random(len(base)) > rng.choice([0, 0.02, 0.1, 0.3, 0.9])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.choice([1, 3, 40, 300]), dtype=np.uint64)])))
        side = rng.integers(0, 2, len(sets)) if rng.random() < 0.5 else np.full(len(sets), -1)
        root = rng.integers(0, 5, len(sets))
        found = _possible(np.array([len(s) for s in sets]), [_signature(s) for s in sets], side, root, percent)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both) and root[i] != root[j] and (side[i] != side[j] or side[i] < 0):
                    assert found[i] and found[j]
        dropped += (~found).sum()
    assert dropped


def test_pieces_are_coded_and_decoded_by_one_process(spark):
    from listwright.llm import pieces

    texts = ["Ab  cd", "", None, "né 中文 \x00 " + "y" * 300, *(f"word{i} the of and {i * i}" for i in range(600))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    one, two = pieces.there_and_back(docs), pieces.decode(pieces.encode(docs))
    assert sorted(map(tuple, one.collect()), key=lambda r: r[0]) == sorted(map(tuple, two.collect()), key=lambda r: r[0])
    assert one._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
