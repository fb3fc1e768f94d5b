"""Every query of the library against its SQL in DuckDB."""

import duckdb
import pytest

from lumaspan import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.SQL[name])
    assert rows(got.columns, map(tuple, got.collect())) == rows([c[0] for c in want.description], want.fetchall())


def test_components_of_chain_and_singleton(spark):
    from lumaspan.operators.vectors import components

    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    assert dict(components(nodes, edges).collect()) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5}


def test_hamming_pairs_by_bands_equal_all_pairs(spark):
    import random

    from lumaspan.operators.vectors import hamming_pairs

    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 15))) for b in base]
    df = spark.createDataFrame([(i, v - (1 << 64) if v >= 1 << 63 else v) for i, v in enumerate(values)], "id long, h long")
    for radius in (0, 3, 12):
        want = {(i, j, (values[i] ^ values[j]).bit_count()) for i in range(40) for j in range(i + 1, 40) if (values[i] ^ values[j]).bit_count() <= radius}
        assert {tuple(r) for r in hamming_pairs(df, "id", "h", radius).collect()} == want


def test_complete_link_groups_are_cliques(spark):
    pairs = {(r.a, r.b) for r in registry.QUERIES["pair_classification"](spark, SF).collect()}
    groups: dict = {}
    for r in registry.QUERIES["complete_link_groups"](spark, SF).collect():
        groups.setdefault(r.anchor, []).append(r.member)
    for g in groups.values():
        assert all((min(a, b), max(a, b)) in pairs for a in g for b in g if a != b)
