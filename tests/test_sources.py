"""File and catalog sources: listing, text objects, registration, statistics."""

import os

import brute
from conftest import SF_SMALL

from veilscan import rules
from veilscan.plans.scan import direct_object_scan, discovery_workflow, full_scan
from veilscan.session import read_table, read_tables
from veilscan.sources import (
    catalog_columns,
    catalog_tables,
    object_inventory,
    object_texts,
    register_sources,
    table_stats,
    tables_stats,
)


def _write_docs(spark, scratch, n=30):
    """Write documents of the small test table as text files (one per doc)."""
    rows = read_table(spark, SF_SMALL, "documents").orderBy("doc_id").limit(n).collect()
    os.makedirs(os.path.join(scratch, "bucket", "sub"), exist_ok=True)
    names = []
    for i, r in enumerate(rows):
        ext = [".txt", ".json", ".bin"][i % 3]
        sub = "sub/" if i % 2 else ""
        p = os.path.join(scratch, "bucket", f"{sub}doc{r['doc_id']:05d}{ext}")
        with open(p, "w", encoding="utf-8") as f:
            f.write(r["text"])
        names.append((p, r["text"]))
    return os.path.join(scratch, "bucket"), names


def test_object_inventory_prunes_content(spark, scratch):
    root, names = _write_docs(spark, scratch)
    inv = object_inventory(spark, root)
    plan = inv._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1].split("\n")[0]
    got = {r["path"].replace("file:", ""): r["size_bytes"] for r in inv.collect()}
    assert got == {p: os.path.getsize(p) for p, _ in names}
    kinds = {r["path"].rpartition(".")[2]: r["content_type"] for r in inv.collect()}
    assert kinds == {"txt": "text/plain", "json": "application/json", "bin": "application/octet-stream"}
    assert len({r["etag"] for r in inv.collect()}) > 1
    sub = object_inventory(spark, root, prefix="sub").count()
    assert sub == sum(1 for p, _ in names if "/sub/" in p)
    d = object_inventory(spark, root, prefix="doc0").collect()
    assert {r["path"].replace("file:", "") for r in d} == {p for p, _ in names if "/sub/" not in p}
    assert object_inventory(spark, root, prefix="sub/doc").count() == sub
    assert object_inventory(spark, root, prefix="nothing-here").count() == 0


def _by_path(rows, column):
    return {r["path"].replace("file:", ""): r[column] for r in rows}


def test_text_objects_and_direct_scan(spark, scratch):
    root, names = _write_docs(spark, scratch)
    inv = object_inventory(spark, root)
    objs = _by_path(inv.join(object_texts(spark, root), "uri").collect(), "text")
    assert objs == {p: t for p, t in names}
    got = {p: list(t) for p, t in _by_path(direct_object_scan(spark, root).collect(), "pii_types").items()}
    want = {p: brute.content_types(t, rules.SIMPLE_PATTERNS) for p, t in names if p.endswith((".txt", ".csv", ".json"))}
    assert got == {p: t for p, t in want.items() if t}


def test_register_sources_and_catalog(spark, scratch):
    base = SF_SMALL
    reg = register_sources(
        spark,
        file_sources={"user-profiles": f"{base}/customer.parquet", "broken-bucket": f"{scratch}/missing"},
        item_sources={"orders": f"{base}/orders.parquet"},
    )
    rows = {r["name"]: r for r in reg.collect()}
    assert rows["user-profiles"]["status"] == "cataloged" and rows["user-profiles"]["database"] == "user_profiles_db"
    assert rows["broken-bucket"]["status"] == "error" and rows["broken-bucket"]["error"]
    assert rows["orders"]["database"] == rules.ITEM_TABLE_DATABASE
    cols = catalog_columns(spark, ["user_profiles_db", rules.ITEM_TABLE_DATABASE, "no_such_db"]).collect()
    names = {(r["database"], r["table_name"], r["column_name"]) for r in cols}
    assert ("user_profiles_db", "user_profiles", "c_name") in names
    assert (rules.ITEM_TABLE_DATABASE, "orders", "o_custkey") in names
    listed = {(r["database"], r["table_name"]): r for r in catalog_tables(spark, ["user_profiles_db", "no_such_db"]).collect()}
    assert listed["user_profiles_db", "user_profiles"]["status"] == "cataloged"
    assert listed["no_such_db", None]["status"] == "error" and listed["no_such_db", None]["error"]
    locs = {r["location"] for r in catalog_columns(spark, ["user_profiles_db"], with_location=True).collect()}
    assert len(locs) == 1 and next(iter(locs)).endswith("customer.parquet")
    res = full_scan(spark, databases=["user_profiles_db", rules.ITEM_TABLE_DATABASE])
    tot = res.totals.first()
    assert tot["total_tables"] == 2 and tot["total_columns"] == 11 and tot["pii_columns_found"] == 1
    resources = {r["resource"] for r in res.registry.collect()}
    assert "user_profiles_db.user_profiles" in resources and any(r.endswith("customer.parquet") for r in resources)


def test_registration_drops_and_replaces_nothing(spark, scratch):
    spark.sql("CREATE DATABASE IF NOT EXISTS kept_db")
    spark.sql("DROP TABLE IF EXISTS kept_db.kept")
    spark.range(5).write.saveAsTable("kept_db.kept")
    path = f"{SF_SMALL}/nation.parquet"
    files = {"kept": path, "two-names": path, "two_names": f"{SF_SMALL}/region.parquet", "dotted.name": path, "odd name": path}
    for _ in range(2):  # a second registration finds the same tables
        rows = {r["name"]: r for r in register_sources(spark, file_sources=files).collect()}
        assert {n: r["status"] for n, r in rows.items()} == {
            "kept": "error", "two-names": "cataloged", "two_names": "error", "dotted.name": "cataloged", "odd name": "cataloged",
        }
    assert "exists" in rows["kept"]["error"] and "two-names" in rows["two_names"]["error"]
    assert spark.table("kept_db.kept").count() == 5
    assert spark.table("dotted_name_db.dotted_name").count() == 25
    spark.sql("DROP TABLE kept_db.kept")


def test_discovery_workflow_writes_report(spark, scratch):
    res = discovery_workflow(
        spark,
        file_sources={"user-profiles": f"{SF_SMALL}/customer.parquet", "audit-trail": f"{SF_SMALL}/events.parquet"},
        item_sources={"patient-payment": f"{SF_SMALL}/orders.parquet"},
        report_path=f"{scratch}/report",
    )
    k = spark.read.json(f"{scratch}/report/kpis").first()
    assert k["total_sources"] == 3 and k["high_risk_sources"] == 2 and k["pii_sources"] == 2
    assert k["compliance_score"] == 100.0
    assert res.source_tags.count() == 12
    assert spark.read.json(f"{scratch}/report/counts").first()["successful"] == 3
    assert {r["tag_key"] for r in spark.read.json(f"{scratch}/report/tag_keys").collect()} == set(rules.SOURCE_TAG_KEYS)
    assert spark.read.json(f"{scratch}/report/catalog").count() == 3
    assert spark.read.json(f"{scratch}/report/type_counts").count() > 0


def test_compliance_falls_when_sources_cannot_be_tagged(spark, scratch):
    res = discovery_workflow(
        spark,
        file_sources={"user-a": f"{SF_SMALL}/customer.parquet", "user-b": f"{scratch}/missing", "billing": f"{scratch}/none"},
    )
    k = res.kpis.first()
    assert k["compliance_score"] < 34 and k["pii_sources"] == 3 and k["uncataloged"] == 2
    assert res.source_tags.count() == 4


def test_table_stats_sizes(spark):
    for name in ("customer", "documents"):
        r = table_stats(read_table(spark, SF_SMALL, name), name).first()
        assert r["size_bytes"] == os.path.getsize(f"{SF_SMALL}/{name}.parquet")
        assert r["item_count"] == read_table(spark, SF_SMALL, name).count()
    names = ["nation", "region"]
    rows = {r["table_name"]: r for r in tables_stats({n: read_table(spark, SF_SMALL, n) for n in names}).collect()}
    assert [a["name"] for a in rows["region"]["attributes"]][:2] == ["r_regionkey", "r_name"]
    assert {n: rows[n]["item_count"] for n in names} == {"nation": 25, "region": 5}


def test_full_scan_over_test_tables(spark):
    from veilscan.plans import standins

    frames = read_tables(spark, SF_SMALL)
    docs = frames["documents"]
    res = full_scan(spark, tables=frames, objects=standins.document_objects(docs),
                    item_tables={"documents": docs, "pages": frames["pages"]})
    sizes = {r["table_name"]: (r["size_bytes"], r["item_count"]) for r in res.item_findings.collect()}
    assert sizes["documents"] == (os.path.getsize(f"{SF_SMALL}/documents.parquet"), docs.count())
    t = res.totals.first()
    assert t["total_columns"] == 63 and t["pii_columns_found"] == 6 and t["total_tables"] == 14
    assert res.column_tags.count() == 6 * 5 + 57 * 4
    reg = {r["resource"]: r["status"] for r in res.registry.collect()}
    assert len(reg) == 14 + t["objects_with_pii"] and set(reg.values()) == {"registered"}
    again = full_scan(spark, tables=frames, objects=standins.document_objects(docs),
                      existing_registry=res.registry.select("resource"), materialize=False)
    assert {r["status"] for r in again.registry.collect()} == {"already_registered"}


def test_scan_object_files_reads_whole_objects(spark, scratch):
    from veilscan.plans.scan import scan_object_files
    from veilscan.sources.heads import object_heads

    root, names = _write_docs(spark, scratch, n=60)
    heads = _by_path(object_heads(object_inventory(spark, root), 1024).collect(), "text")
    assert heads == {p: brute.head_bytes(t) for p, t in names}
    late = os.path.join(root, "late.txt")
    with open(late, "w", encoding="utf-8") as f:
        f.write("x " * 5000 + "late@mail.org")
    got = {p: list(t) for p, t in _by_path(scan_object_files(spark, root).collect(), "pii_types").items()}
    want = {p: brute.content_types(t) for p, t in names} | {late: ["EMAIL"]}
    assert got == {p: t for p, t in want.items() if t}


def test_no_object_is_lost(spark, scratch):
    """Odd names are found, and what cannot be read is told from what is clean."""
    from veilscan.plans.scan import scan_objects_under
    from veilscan.sources.objects import object_findings

    root = os.path.join(scratch, "odd")
    os.makedirs(root)
    odd = ["plain.txt", "a b.txt", "a#b.txt", "a?b.txt", "a%20b.txt", "ü+x.txt"]
    for name in odd:
        with open(os.path.join(root, name), "w", encoding="utf-8") as f:
            f.write("mail me: jane@x.org")
    open(os.path.join(root, "nothing.txt"), "w").close()
    with open(os.path.join(root, "bytes.bin"), "wb") as f:
        f.write(b"\xff\xfe bad \xc3 but 123-45-6789 here")
    found = scan_objects_under(spark, root)
    status = {os.path.basename(p): s for p, s in _by_path(found.collect(), "status").items()}
    types = {os.path.basename(p): t for p, t in _by_path(found.collect(), "pii_types").items()}
    assert status == {n: "scanned" for n in [*odd, "bytes.bin"]} | {"nothing.txt": "empty"}
    assert types == {n: ["EMAIL"] for n in odd} | {"bytes.bin": ["SSN"], "nothing.txt": []}
    inv = object_inventory(spark, root)
    gone = object_findings(inv, object_texts(spark, root).where("uri NOT LIKE '%plain.txt'")).collect()
    assert {os.path.basename(r["path"]): r["status"] for r in gone}["plain.txt"] == "unreadable"


def test_run_scan_with_config(spark, scratch):
    from veilscan.plans.scan import ScanConfig, run_scan

    root, names = _write_docs(spark, scratch, n=40)
    register_sources(spark, file_sources={"user-profiles": f"{SF_SMALL}/customer.parquet"})
    cfg = ScanConfig(databases=["user_profiles_db"], object_paths=[root], item_tables={"docs": f"{SF_SMALL}/documents.parquet"})
    res = run_scan(spark, cfg)
    t = res.totals.first()
    want_objs = sum(1 for _, txt in names if brute.content_types(txt))
    assert t["objects_with_pii"] == want_objs and t["total_columns"] == 5 and t["pii_columns_found"] == 1
    assert t["total_sources"] == 1 + want_objs + t["item_tables_with_pii"]
    assert {r["status"]: r["objects"] for r in res.object_status.collect()} == {"scanned": 40}


def test_cli_mask_and_scan(spark, scratch, capsys):
    from veilscan.__main__ import main
    from veilscan.plans import standins

    src = f"{scratch}/people"
    standins.people(read_table(spark, SF_SMALL, "customer")).write.parquet(src)
    assert main(["mask", src, f"{scratch}/masked", "--rule", "NAME=full_mask"]) == 0
    out = spark.read.parquet(f"{scratch}/masked")
    assert out.where("c_name NOT RLIKE '^[*]+$'").count() == 0
    assert main(["scan", "--tables", SF_SMALL]) == 0
    line = [x for x in capsys.readouterr().out.splitlines() if x.startswith("{")][-1]
    import json

    assert json.loads(line)["total_columns"] == 63


def test_discover_sources_and_workflow_from_roots(spark, scratch):
    from veilscan.plans.scan import discovery_from_roots
    from veilscan.sources import discover_sources

    root = f"{scratch}/lake"
    for name, table in (("user-profiles", "customer"), ("audit-trail", "events"), ("billing-exports", "orders")):
        read_table(spark, SF_SMALL, table).write.parquet(f"{root}/{name}")
    register_sources(spark, item_sources={"orders": f"{SF_SMALL}/orders.parquet"})
    found = {(r["type"], r["name"]) for r in discover_sources(spark, [root], [rules.ITEM_TABLE_DATABASE]).collect()}
    assert {("file", "user-profiles"), ("file", "audit-trail"), ("file", "billing-exports"), ("table", "orders")} <= found
    res = discovery_from_roots(spark, [root])
    risk = {r["source"]: r["risk_level"] for r in res.classified.collect()}
    assert risk == {"user-profiles": "HIGH", "audit-trail": "NO_RISK", "billing-exports": "MEDIUM"}


def test_register_many_sources_concurrently(spark, scratch):
    from veilscan.session import TABLES

    files = {f"src-{i:02d}-{t}": f"{SF_SMALL}/{t}.parquet" for i, t in enumerate(TABLES)}
    files.update({f"missing-{i}": f"{scratch}/none-{i}" for i in range(4)})
    rows = register_sources(spark, file_sources=files, parallelism=6).collect()
    assert [r["name"] for r in rows] == list(files)
    status = {r["name"]: r["status"] for r in rows}
    assert sum(v == "cataloged" for v in status.values()) == len(TABLES)
    assert all(status[f"missing-{i}"] == "error" for i in range(4))
    cols = catalog_columns(spark, [f"src_{i:02d}_{t}_db" for i, t in enumerate(TABLES)]).count()
    assert cols == 63


def test_unreadable_objects_and_missing_roots(spark, scratch):
    from veilscan.operators import findings as FD
    from veilscan.sources import discover_sources
    from veilscan.sources.heads import object_heads

    root, names = _write_docs(spark, scratch, n=6)
    inv = object_inventory(spark, root)
    gone = spark.createDataFrame([(f"{scratch}/no-such-object.txt", 10)], "path string, size_bytes long")
    other = spark.createDataFrame([("nosuch://bucket/key", 10)], "path string, size_bytes long")
    rows = object_heads(inv.select("path", "size_bytes").unionByName(gone).unionByName(other), 64).collect()
    heads, status = _by_path(rows, "text"), _by_path(rows, "status")
    assert heads[f"{scratch}/no-such-object.txt"] is None
    assert status[f"{scratch}/no-such-object.txt"] == status["nosuch://bucket/key"] == "error"
    assert all(r["error"] for r in rows if r["status"] == "error")
    assert all(heads[p] == brute.head_bytes(t, 64) for p, t in names)
    found = FD.scan_objects(object_heads(gone, 64)).count()
    assert found == 0
    assert discover_sources(spark, [f"{scratch}/missing-root"]).count() == 0


def test_partitions_are_taken_into_the_catalog(spark, scratch):
    """Registered once and again after a partition was added; the catalog has all of them."""
    from veilscan.sources import catalog_partitions

    path = f"{scratch}/parted"
    write = lambda days, mode: spark.createDataFrame(days, "id int, day string, k int").write.mode(mode).partitionBy("day", "k").parquet(path)
    write([(1, "2024-01-01", 1), (2, "a b/c", 2)], "overwrite")
    files = {"parted-source": path, "plain": f"{SF_SMALL}/nation.parquet"}
    dbs = ["parted_source_db", "plain_db"]
    for expected in (2, 3):
        assert {r["status"] for r in register_sources(spark, file_sources=files).collect()} == {"cataloged"}
        rows = catalog_partitions(spark, dbs).collect()
        assert len(rows) == expected and {r["table_name"] for r in rows} == {"parted_source"}
        assert spark.table("parted_source_db.parted_source").count() == expected
        assert spark.table("parted_source_db.parted_source").where("day = 'a b/c'").count() == 1
        if expected == 2:
            write([(3, "2024-01-02", 1)], "append")
    assert [r["column_name"] for r in catalog_columns(spark, dbs[:1]).orderBy("ordinal").collect()] == ["id", "day", "k"]
    spark.sql("DROP TABLE parted_source_db.parted_source")


def test_round_trip_is_idempotent(spark):
    from veilscan.plans.queries import QUERIES

    first, again = (sorted(map(tuple, QUERIES["catalog_round_trip"](spark, SF_SMALL).collect())) for _ in range(2))
    assert first == again and len(first) == 63


def test_risk_breakdown_levels_add_up(spark):
    from veilscan.operators.reports import risk_breakdown

    rows = [("file", "HIGH", ["EMAIL"], True), ("file", None, [], False), ("table", "HIGH", ["SSN"], True), (None, "NO_RISK", [], True)]
    df = spark.createDataFrame(rows, "type string, risk_level string, pii_types array<string>, tagged boolean")
    found = risk_breakdown(df).collect()
    for level in ("type,risk_level", "type", "risk_level", "total"):
        mine = [r for r in found if r["level"] == level]
        assert sum(r["sources"] for r in mine) == 4 and sum(r["with_pii"] for r in mine) == 2
        assert round(sum(r["share"] for r in mine)) == 100
    assert {(r["type"], r["sources"]) for r in found if r["level"] == "type"} == {("file", 2), ("table", 1), (None, 1)}
    assert risk_breakdown(df.limit(0)).collect() == []
