"""Nodes that share a frequent shingle: what is sent to be compared, and that no link is lost."""

from by_hand import components_by_hand

from pagequarry.llm import jaccard


def homes(spark, n):
    return spark.range(n).selectExpr("id as node", "array(7L) as homes")


def sent(spark, roots_sql, n):
    roots = spark.range(n).selectExpr("id as node", f"cast({roots_sql} as long) as root")
    return jaccard.tiles(homes(spark, n), roots)


def test_one_node_beside_a_large_family_takes_each_body_once(spark):
    n = 20_000
    assert sent(spark, f"if(id = {n - 1}, id, 0)", n).count() <= n + n // jaccard.BLOCK + 2
    assert sent(spark, "0", n).count() == 0


def test_tiles_hold_every_pair_of_different_components(spark):
    n = 700
    for roots_sql in ("id", "if(id < 400, 0, id)", "id div 50", "if(id < 350, 0, 1000)"):
        tiles = {}
        for r in sent(spark, roots_sql, n).collect():
            tiles.setdefault((r.kind, r.i, r.j), ([], []))[r.side].append(r.node)
        met = set()
        for (kind, i, j), (left, right) in tiles.items():
            assert len(left) <= 4 * jaccard.BLOCK and len(right) <= 4 * jaccard.BLOCK
            right = left if kind == 0 and i == j else right
            met |= {(min(a, b), max(a, b)) for a in left for b in right}
        roots = {r.node: r.root for r in spark.range(n).selectExpr("id as node", f"{roots_sql} as root").collect()}
        assert all((a, b) in met for a in range(n) for b in range(a + 1, n) if roots[a] != roots[b])


def test_boilerplate_with_few_own_words(spark):
    """Texts of one long notice and a few words of their own, some of them near copies of each other."""
    notice = " ".join(f"n{i}" for i in range(60))
    rows = [(i, f"{notice} " + " ".join(f"w{(i // 3 if i % 3 else i) * 10 + k}" for k in range(4 + i % 5))) for i in range(400)]
    rows += [(1000 + i, f"{notice} tail{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in jaccard.component_ids(docs).collect())
    assert got == sorted(components_by_hand(rows, 4, 85))


def test_slices_follow_the_volume(spark, monkeypatch):
    """Counts stay exact however many slices the texts are counted in."""
    docs = spark.createDataFrame([(f"all rights are reserved here u{i} v{i} w{i}",) for i in range(60)], "text string")
    want = jaccard.frequent_shingles(docs, 4)
    monkeypatch.setattr(jaccard, "SLICE_LETTERS", 1)
    monkeypatch.setattr(jaccard, "SLICES", 2)
    got = jaccard.frequent_shingles(docs.repartition(7), 4)
    assert [x.tolist() for x in got] == [x.tolist() for x in want] and want[1].tolist() == [60, 60]
