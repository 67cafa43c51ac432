"""Random statements from templates, on the engine and on DuckDB."""

import random

import duckdb
import pytest

from cairnql.plans.engine import Engine

TABLES = {
    "customer": {"int": ["c_custkey", "c_nationkey"], "float": ["c_acctbal"], "text": ["c_mktsegment", "c_name"]},
    "orders": {"int": ["o_orderkey", "o_custkey"], "float": ["o_totalprice"], "text": ["o_orderstatus", "o_orderpriority"]},
    "part": {"int": ["p_partkey", "p_size"], "float": ["p_retailprice"], "text": ["p_brand", "p_type"]},
}
JOINS = [("customer", "orders", "c_custkey = o_custkey"), ("nation", "customer", "n_nationkey = c_nationkey"), ("part", "lineitem", "p_partkey = l_partkey")]
TEXTS = ["'BUILDING'", "'F'", "'1-URGENT'", "'SMALL'", "'O'", "''", "NULL"]


def number(r, cols):
    """An expression that is null now and then and the same in both dialects."""
    a = r.choice(cols["int"] + cols["float"])
    return r.choice([a, f"{a} + {r.randint(-9, 9)}", f"{a} * {r.randint(0, 3)}", f"-{a}", f"NULLIF({a}, {r.randint(0, 30)})", f"CASE WHEN {a} < {r.randint(0, 2000)} THEN {a} END"])


def predicate(r, cols, depth=2):
    if depth and r.random() < 0.6:
        a, b = predicate(r, cols, depth - 1), predicate(r, cols, depth - 1)
        return r.choice([f"({a} AND {b})", f"({a} OR {b})", f"NOT ({a})"])
    x, y = number(r, cols), number(r, cols)
    t = r.choice(cols["text"])
    return r.choice([
        f"{x} {r.choice(['=', '<>', '<', '>', '<=', '>='])} {r.choice([y, str(r.randint(-5, 3000)), 'NULL'])}",
        f"{x} BETWEEN {r.randint(-10, 50)} AND {r.randint(0, 4000)}", f"{x} IS {r.choice(['', 'NOT '])}NULL",
        f"{t} {r.choice(['=', '<>', '<', '>='])} {r.choice(TEXTS)}", f"{t} LIKE '{r.choice('ABEIOS')}%'", f"{t} IN ({', '.join(r.sample(TEXTS[:-1], 2))})",
    ])


def select(r):
    name = r.choice(list(TABLES))
    cols = TABLES[name]
    kind = r.randrange(5)
    where = f" WHERE {predicate(r, cols)}" if r.random() < 0.8 else ""
    if kind == 0:
        return f"SELECT {r.choice(['', 'DISTINCT '])}{number(r, cols)} AS a, {r.choice(cols['text'])} AS b FROM {name}{where}"
    if kind == 1:
        g = r.choice(cols["text"])
        x = r.choice(cols["int"])
        having = f" HAVING COUNT(*) > {r.randint(0, 20)}" if r.random() < 0.5 else ""
        return f"SELECT {g} AS g, COUNT(*) AS n, COUNT({number(r, cols)}) AS c, CAST(SUM({x}) AS BIGINT) AS s, MIN({number(r, cols)}) AS lo, MAX({g}) AS hi, COUNT(DISTINCT {x}) AS d FROM {name}{where} GROUP BY {g}{having}"
    if kind == 2:
        key = cols["int"][0]
        return f"SELECT {key} AS k, {number(r, cols)} AS x FROM {name}{where} ORDER BY x {r.choice(['ASC', 'DESC'])} NULLS {r.choice(['FIRST', 'LAST'])}, k LIMIT {r.randint(0, 30)}"
    if kind == 3:
        a, b, on = r.choice(JOINS)
        how = r.choice(["JOIN", "LEFT JOIN", "RIGHT JOIN", "FULL JOIN"])
        left, right = (x.strip() for x in on.split("="))
        more = f" AND {left} > {r.randint(0, 50)}" if r.random() < 0.5 else ""
        return f"SELECT {left} AS a, {right} AS b, COUNT(*) AS n FROM {a} {how} {b} ON {on}{more} GROUP BY {left}, {right}"
    other = r.choice(list(TABLES))
    op = r.choice(["UNION", "UNION ALL", "INTERSECT", "EXCEPT", "EXCEPT ALL", "INTERSECT ALL"])
    return f"SELECT CAST({r.choice(cols['int'])} AS BIGINT) AS k FROM {name}{where} {op} SELECT CAST({r.choice(TABLES[other]['int'])} AS BIGINT) FROM {other}"


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else v


def same(got, want):
    key = lambda t: tuple((v is not None, str(v)) for v in t)
    a, b = (sorted((tuple(plain(v) for v in t) for t in x), key=key) for x in (got, want))
    return a == b


@pytest.mark.parametrize("seed", range(40))
def test_queries(seed, spark, sf):
    r = random.Random(seed)
    con = duckdb.connect()
    for t in [*TABLES, "nation", "lineitem"]:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        spark.read.parquet(f"{sf}/{t}.parquet").createOrReplaceTempView(t)
    text = select(r)
    assert same(spark.sql(text).collect(), con.sql(text).fetchall()), text


@pytest.mark.parametrize("seed", range(3))
def test_changes(seed, spark, tmp_path):
    """A random series of changes; the table, its view and the counts stay those of DuckDB."""
    r = random.Random(1000 + seed)
    ddl = "CREATE TABLE t (id INTEGER NOT NULL, g INTEGER, x BIGINT, s VARCHAR(20) DEFAULT 'none', PRIMARY KEY (id));"
    e = Engine(spark, str(tmp_path), ddl + "CREATE VIEW v (g, n, x, c) AS SELECT g, COUNT(*), SUM(x), COUNT(s) FROM t WHERE x > -50 GROUP BY g;")
    con = duckdb.connect()
    con.sql("CREATE TABLE t (id INTEGER PRIMARY KEY, g INTEGER, x BIGINT, s VARCHAR DEFAULT 'none')")
    fresh = 0

    def value(kind):
        return "NULL" if r.random() < 0.15 else str(r.randint(-60, 60)) if kind == "int" else f"'{r.choice(['a', 'b', 'it''s', 'x;y'])}'"

    for _ in range(9):
        kind = r.choice(["insert", "insert", "select", "update", "update", "delete"])
        cond = r.choice([f"x > {r.randint(-60, 60)}", f"g = {r.randint(-3, 3)}", f"s = 'a' OR x < {r.randint(-60, 0)}", f"id % {r.randint(2, 4)} = 1", "g IS NULL"])
        if kind == "insert":
            rows = []
            for _ in range(r.randint(1, 6)):
                fresh += 1
                rows.append((str(fresh), str(r.randint(-3, 3)) if r.random() < 0.8 else "NULL", value("int"), value("text")))
            whole = r.random() < 0.7
            text = f"INSERT INTO t {'' if whole else '(id, g, x) '}VALUES {', '.join('(' + ', '.join(x if whole else x[:3]) + ')' for x in rows)}"
        elif kind == "select":
            text = f"INSERT INTO t SELECT id + {fresh}, g, x + 1, s FROM t WHERE {cond}"
            fresh *= 2
        elif kind == "update":
            text = f"UPDATE t SET {r.choice(['x = x + g', 'g = NULL', 's = s || s', 'x = -x, g = g + 1', 'x = g, g = x'])} WHERE {cond}"
        else:
            text = f"DELETE FROM t WHERE {cond}"
        n = e.sql(text).first()[0]
        assert n == con.execute(text).fetchone()[0], text
    assert same(e.sql("SELECT * FROM t").collect(), con.sql("SELECT * FROM t").fetchall())
    assert same(e.sql("SELECT * FROM v").collect(), con.sql("SELECT g, COUNT(*), SUM(x), COUNT(s) FROM t WHERE x > -50 GROUP BY g").fetchall())
