"""Sources: the artwork JSON corpus round trip and the reference seeds."""

import json
import os
from decimal import Decimal

from decantry.operators import catalog as C
from decantry.operators import rewards as R
from decantry.sources import artworks as A
from decantry.sources import seeds


def test_artwork_corpus_reads_nested_json(spark, tmp_dir):
    doc = {"works": [{"id": "w1", "name": "Eros", "brand": "Versace", "artwork": "a.webp",
                      "accords": ["fresh", "sweet", "woody"], "notes": ["mint", "apple", "vanilla", "tonka"],
                      "description": "x"},
                     {"id": "w2", "name": "CK One", "brand": "Calvin Klein", "artwork": "b.webp",
                      "accords": ["citrus", "green", "musky"], "notes": ["bergamot", "tea", "musk", "amber", "lemon"],
                      "description": "y"}]}
    path = os.path.join(tmp_dir, "artworks.json")
    with open(path, "w") as f:
        json.dump(doc, f, indent=2)
    works = A.read_artworks(spark, path)
    assert works.count() == 2
    assert sorted(len(r.notes) for r in works.collect()) == [4, 5]


def test_artwork_writer_round_trip(spark, sf_small, tmp_dir):
    from decantry.sources import driver as D
    museum = D.f_museum(spark, sf_small)
    out = os.path.join(tmp_dir, "museum_json")
    A.write_artworks(museum, out, works_per_document=7)       # many documents per file
    back = A.read_artworks(spark, out, multi_line=False)
    assert back.count() == museum.count()


def test_catalog_seed_if_absent(spark):
    seed = seeds.catalog_seed(spark)
    assert seed.count() == 23
    snap = seed.limit(5)
    merged = C.seed_if_absent(snap, seed, ["name"])
    assert merged.count() == 23
    row = merged.filter("name = 'Bal d''Afrique'").collect()[0]
    assert row.price_10ml == Decimal("36.70")


def test_reward_seed_threshold_edges(spark):
    rewards = seeds.reward_seed(spark)
    bal = spark.createDataFrame([(1, 29), (2, 30), (3, 75), (4, 300)], "customer_id long, bookmarks long")
    got = {r.customer_id: (r.n_unlocked, r.top_threshold, r.next_threshold)
           for r in R.unlocked_rewards(bal, rewards).collect()}
    assert got == {1: (0, None, 30), 2: (1, 30, 75), 3: (2, 75, 150), 4: (4, 250, None)}


def test_order_snapshot_prunes_status_partitions(spark, sf_small, tmp_dir):
    from pyspark.sql import functions as F

    from decantry.sources import driver as D
    from decantry.sources import snapshots as SN
    core = D.f_orders_core(spark, sf_small).select("id", "order_total", "status", "created_at")
    path = os.path.join(tmp_dir, "orders_snapshot")
    SN.write_snapshot(SN.with_order_layout(core), path, num_partitions=4)
    snap = SN.read_snapshot(spark, path)
    assert snap.count() == core.count()
    delivered = snap.filter(F.col("status") == "delivered")
    plan = delivered._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan and "(status" in plan
    assert delivered.count() == core.filter(F.col("status") == "delivered").count()
    # Dynamic overwrite: rewriting only the cancelled orders leaves the other folders alone.
    SN.write_snapshot(SN.with_order_layout(core.filter(F.col("status") == "cancelled")), path, num_partitions=2)
    assert SN.read_snapshot(spark, path).count() == core.count()


def test_artwork_documents_are_bounded(spark, sf_small, tmp_dir):
    from decantry.sources import driver as D
    museum = D.f_museum(spark, sf_small)
    out = os.path.join(tmp_dir, "museum_docs")
    A.write_artworks(museum, out, works_per_document=50)
    docs = spark.read.schema(A.DOCUMENT).json(out)
    sizes = [len(r.works) for r in docs.collect()]
    assert max(sizes) <= 50 and sum(sizes) == museum.count()


def test_cli_lists_and_prints_sql(capsys):
    from decantry.__main__ import main
    assert main(["list"]) == 0
    out = capsys.readouterr().out
    assert "catalog_with_stock" in out and "O-C2" in out
    assert main(["sql", "catalog_with_stock"]) == 0
    assert "WITH RECURSIVE" in capsys.readouterr().out
    assert main(["sql", "no_such_query"]) == 2


def test_package_is_shipped_to_workers_once(spark):
    from decantry import session as SE
    SE.ship_package(spark)
    before = len(SE._SHIPPED)
    SE.ship_package(spark)                                   # idempotent per session
    assert len(SE._SHIPPED) == before and id(spark) in SE._SHIPPED

    def probe(batches):
        import importlib
        import pandas as pd
        for b in batches:
            mod = importlib.import_module("decantry.operators.fold")
            yield pd.DataFrame({"ok": [hasattr(mod, "KeyState")] * len(b)})
    assert all(r.ok for r in spark.range(4).mapInPandas(probe, "ok boolean").collect())
