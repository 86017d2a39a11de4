"""The registered queries with SQL on given tables, and contracts of those without."""

import hashlib
import re

import duckdb
import pytest

from listwright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_like_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(map(tuple, df.collect()), df.columns) == plain(found.fetchall(), columns)


def texts():
    return duckdb.sql(f"select doc_id, coalesce(text, '') as text from '{SF}/documents.parquet'").fetchall()


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def test_licenses_contract(spark):
    want = []
    for i, t in texts():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        at = sorted((k, label) for p, label in PHRASES.items() for k in range(len(w) - len(p) + 1) if tuple(w[k : k + len(p)]) == p)
        want.append((i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    got = QUERIES["op1_licenses"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == sorted(want)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_secrets_contract(spark):
    kinds = {"assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    ok = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    want = {}
    for i, t in texts():
        found = sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, t) if ok[k](m))
        want[i] = ([sum(f[2] == k for f in found) for k in kinds], digest((k, a, b) for a, _, k, b in found))
    for r in QUERIES["op3_secrets"](spark, SF).collect():
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == want[r.doc_id]


def luhn(number):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(number)))) % 10 == 0


def test_pii_contract(spark):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    want = {}
    for i, t in texts():
        found = [[(k, m.start(), m.end()) for m in re.finditer(p, t) if ok(m)] for k, (p, ok) in kinds.items()]
        want[i] = ([len(f) for f in found], digest(x for f in found for x in f))
    for r in QUERIES["op2_pii"](spark, SF).collect():
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == want[r.doc_id]
