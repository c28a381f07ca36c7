"""The tick lake on small hand-made trades."""

from datetime import date, datetime

import pytest
from pyspark.sql import Row, functions as F

from tidemill import schema
from tidemill.functions import symbols, timeutil as tu
from tidemill.functions.redaction import BLANK, redact
from tidemill.operators import analytics as an, calendar as cal, catalog, continuous as co, ingest, integrity, migrate, resilience
from tidemill.sources import maintenance as care, reference_data as ref, store
from tidemill.sources.catalog_store import Catalog
from tidemill.streaming import ingest as stream
from tidemill.streaming.progress import Progress, Registry, Switch

NS = 1_700_000_000_000_000_000


def trades(spark, n=2000):
    return ingest.to_canonical(ref.synthetic_trades(spark, n), version="t")


def test_sequence_and_dedup_keys(spark):
    rows = [Row(symbol="A", timestamp_ns=NS, trade_id=i, price=p, quantity=1, buy_agent_id=b, sell_agent_id=None, arrival=k) for k, (i, p, b) in enumerate([(1, 5.0, 1), (1, 6.0, 1), (None, 5.0, None), (None, 5.0, None), (None, 5.0, 2)])]
    df = spark.createDataFrame(rows, "symbol string, timestamp_ns long, trade_id long, price double, quantity long, buy_agent_id int, sell_agent_id int, arrival long")
    seq = ingest.sequence(df)
    assert [r.sequence_within_ns for r in seq.orderBy("arrival").collect()] == [0, 1, 2, 3, 4]
    assert sorted(r.arrival for r in ingest.dedup(seq).collect()) == [0, 2, 3, 4]
    flat = df.withColumn("sequence_within_ns", F.lit(0))
    assert sorted(r.arrival for r in ingest.dedup(flat).collect()) == [0, 2, 4]


def test_dedup_is_idempotent(spark):
    t = ingest.dedup(ingest.sequence(trades(spark)))
    again = ingest.dedup(t.unionByName(t.withColumn("arrival", F.col("arrival") + 10_000)))
    assert again.count() == t.count() and again.agg(F.max("arrival")).first()[0] < 10_000


def test_validation_reports_the_first_offender(spark):
    t = trades(spark, 50)
    assert ingest.validate(t) is t
    bad = t.withColumn("price", F.when(F.col("arrival") == 7, float("nan")).otherwise(F.col("price")))
    with pytest.raises(ingest.TradeError, match="price.* 7"):
        ingest.validate(bad)
    with pytest.raises(schema.SchemaError):
        schema.guard(t.withColumn("odd", F.lit(1)))


@pytest.mark.parametrize(("text", "ns"), [("02/01/2024 03:04:05.678", 1704164645678000000), ("02/01/2024 03:04:05:678", 1704164645678000000), ("02/01/2024 03:04:05.123456", 1704164645123456000), ("2024-01-02", None)])
def test_times(spark, text, ns):
    got = spark.range(1).select(tu.parse_ns(F.lit(text)).alias("x"), tu.format_ns(F.lit(ns).cast("long")).alias("y")).first()
    assert got.x == ns and (ns is None or got.y == text[:19] + "." + text[20:23])


def test_round_trip_merge_and_compaction(spark, tmp_path):
    root = str(tmp_path / "lake")
    assert store.read(spark, root, "WDOJ26", date(2023, 1, 1), date(2024, 1, 1)).count() == 0
    t = ingest.dedup(ingest.sequence(trades(spark)))
    n = t.count()
    assert sum(r.row_count for r in store.write(t.drop("arrival"), root).collect()) == n
    back = store.read(spark, root, "WDOJ26", date(2023, 11, 14), date(2023, 11, 14), columns=["price", "nope"])
    assert back.columns == ["price"] and back.count() == n == store.count(spark, root, "WDOJ26")
    store.merge_write(t, root)
    assert store.count(spark, root, "WDOJ26") == n
    store.merge_write(t.limit(5).withColumn("timestamp_ns", F.col("timestamp_ns") + tu.DAY_NS), root)
    assert store.count(spark, root, "WDOJ26") == n + 5
    assert store.compact(spark, root, str(tmp_path / "month"), "F", "WDOJ26", 2023, 11) == n + 5
    files = store.files(spark, root)
    assert files.count() == 2 and files.where("length(checksum_sha256) = 64").count() == 2
    assert store.footer(spark, root).where("key like '%spark%'").count() > 0
    with pytest.raises(ValueError):
        store.write(t.drop("arrival"), root, row_limit=10)


@pytest.mark.parametrize(("mode", "last"), [("end_of_day", "A"), ("midnight", None)])
def test_continuous(spark, mode, last):
    c = spark.createDataFrame([("R", "A", date(2024, 1, 1), date(2024, 1, 31)), ("R", "B", date(2024, 1, 20), date(2024, 2, 28)), ("R", "C", date(2024, 3, 1), date(9999, 12, 31))], "symbol_root string, contract_code string, vigent_from date, vigent_until date")
    at = [("A", datetime(2024, 1, 15, 9)), ("A", datetime(2024, 1, 31, 9)), ("B", datetime(2024, 1, 25)), ("B", datetime(2024, 2, 15)), ("C", datetime(2024, 3, 15))]
    t = spark.createDataFrame([(s, tu.to_ns(x), 0, 1.0) for s, x in at], "symbol string, timestamp_ns long, sequence_within_ns int, price double")
    rows = co.read_continuous(t, c, "R", 0, tu.MAX_NS, mode).collect()
    assert [r._contract_code for r in rows] == ["A", *(["A"] if last else []), "B", "C"]
    assert [r._rollover_event for r in rows] == [False, *([False] if last else []), True, True]
    moves = co.transitions(co.stitch(t, co.slices(c, 0, tu.MAX_NS, mode))).orderBy("boundary_ts_ns").collect()
    assert [(m.from_contract, m.to_contract) for m in moves] == [("A", "B"), ("B", "C")]
    days = spark.createDataFrame([("R", date(2024, 1, 25)), ("R", date(2024, 2, 29))], "symbol_root string, day date")
    assert [(r.day.day, r.contract_code) for r in co.vigent(days, c).collect()] == [(25, "B")]


def test_calendar(spark):
    off = cal.exchange_holidays()
    assert date(2024, 2, 12) in off and date(2024, 11, 20) in off and date(2023, 11, 20) not in off and date(2025, 4, 18) in off and date(2030, 6, 20) in off
    days = cal.business_days(spark, "2024-02-09", "2024-02-16", cal.holidays(spark))
    assert sorted(r.day.day for r in days.collect()) == [9, 14, 15, 16]
    assert cal.business_days(spark, "2024-02-16", "2024-02-09", cal.holidays(spark)).count() == 0
    ledger = spark.createDataFrame([("A", date(2024, 2, d), s) for d, s in ((9, "completed"), (14, "no_trades"), (15, "failed"))], "symbol string, chunk_date date, status string")
    assert sorted(r.day.day for r in cal.pending(days, ledger).collect()) == [15, 16]
    assert [r.complete for r in cal.month_complete(days, ledger).collect()] == [False]
    assert [(r.start_day.day, r.end_day.day) for r in cal.chunk_plan(days, 3).orderBy("chunk").collect()] == [(9, 15), (16, 16)]


def test_holiday_file_and_seed(spark, tmp_path):
    path = tmp_path / "h.dat"
    path.write_bytes("﻿// c\r\n66:202501010000000:::New\r\n70:202501010000000:::New\r\n66:202502030000000:1000::Half\r\n89:202507040000000:::NY\r\n".encode())
    assert [r.day for r in ref.holidays_file(spark, str(path)).collect()] == [date(2025, 1, 1)]
    path.write_text("junk\n")
    with pytest.raises(Exception, match="bad holiday line"):
        ref.holidays_file(spark, str(path)).collect()
    seed = ref.contract_seed(spark, '```yaml\ncontracts:\n  # x\n  - symbol_root: W\n    contract_code: WJ26\n    vigent_from: 2026-01-01\n    vigent_until: 9999-12-31\n    validated_at: null\n    notes: "a: b # c"\n```')
    assert seed.first().notes == "a: b # c" and seed.first().vigent_until == date(9999, 12, 31)


def test_integrity_and_catalog(spark):
    t = ingest.dedup(ingest.sequence(trades(spark, 100))).withColumn("ingestion_ts_ns", F.col("timestamp_ns"))
    assert integrity.roll_up(integrity.report(t)).first().passed
    assert integrity.report(t.limit(0)).where("not passed").count() == 0
    bad = integrity.report(t.unionByName(t))
    assert [r.check for r in bad.where("not passed").collect()] == ["INT-2"] and integrity.roll_up(bad).first().worst == "critical"
    cat = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "partition_path string, checksum_sha256 string")
    disk = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4")], "partition_path string, checksum_sha256 string")
    assert {r.partition_path: r.drift for r in catalog.reconcile(cat, disk).collect()} == {"a": "B", "b": None, "c": "C", "d": "A"}
    up = catalog.upsert(cat, spark.createDataFrame([("a", None), ("z", "9")], "partition_path string, checksum_sha256 string"), ["partition_path"])
    assert {r.partition_path: r.checksum_sha256 for r in up.collect()} == {"a": None, "b": "2", "c": "3", "z": "9"}
    assert catalog.may_move("failed", "in_progress") and not catalog.may_move("completed", "pending")


def test_migration(spark):
    old = trades(spark, 20).drop("arrival").select(*schema.TRADE_V1_0.names).withColumn("trade_type", F.lit(99).cast("smallint"))
    new = migrate.migrate(old, "1.0.0")
    assert new.columns == schema.TRADE.names and new.first().trade_type_name == "TradeType#99"
    assert migrate.v1_0_to_v1_1(new).collect() == new.collect()
    with pytest.raises(ValueError):
        migrate.path("1.1.0", "9.0.0")


def test_analytics(spark):
    t = trades(spark, 500)
    rows = [r for r in t.orderBy("timestamp_ns", "sequence_within_ns").collect()]
    e = None
    one = t.dropDuplicates(["timestamp_ns"])
    for r in one.orderBy("timestamp_ns").collect():
        e = r.price if e is None else (2 / 21) * r.price + (1 - 2 / 21) * e
    assert an.ema(one).first().ema == pytest.approx(e, rel=1e-12)
    v = sum(r.price * r.quantity for r in rows) / sum(r.quantity for r in rows)
    assert an.vwap(t, "symbol").first().vwap == pytest.approx(v)
    assert an.vwap(t.withColumn("quantity", F.lit(0).cast("long")), "symbol").first().vwap != an.vwap(t, "symbol").first().vwap
    z = an.signals(an.bars(t, 1_000_000_000 // 50)).orderBy("bar_ns").toPandas()
    roll = z.close.rolling(10)
    assert ((z.close - roll.mean()) / roll.std() - z.zscore).abs().max() < 1e-9


def test_symbols(spark):
    row = spark.range(1).select(symbols.resolve_alias(F.lit(" wdo ")).alias("a"), symbols.contract_code(F.lit("WDO"), F.lit(2026), F.lit(4)).alias("b"), symbols.month_of_letter(F.lit("i")).alias("c"), symbols.parse_partition_path(F.lit("F/X/2024/02/03.parquet")).alias("d"), symbols.semver_at_least(F.lit("1.10.0"), "1.9.0").alias("e"), symbols.number_pt(F.lit(1234567)).alias("f"), symbols.duration(F.lit(3725)).alias("g")).first()
    assert (row.a, row.b, row.c, row.d.day, row.e, row.f, row.g) == ("WDOFUT", "WDOJ26", None, 3, True, "1.234.567", "01:02:05")


def test_formats_agrees_with_its_sql_on_long_times_and_nulls(spark, tmp_path):
    import duckdb
    from tidemill.plans import catalogue

    rows = [(0, 1), (9729, 10), (9730, 9), (27028, 50), (9_999_999, None), (None, 3), (-1, 4), (-100, 5), (-9730, 6)]
    parts = spark.createDataFrame(rows, "p_partkey long, p_size int")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got, want = catalogue.QUERIES["formats"](spark, str(tmp_path)), con.sql(catalogue.ORACLE_SQL["formats"]).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) == len(rows)
    whole = {r.p_partkey: r.t for r in parts.select("p_partkey", symbols.duration(F.col("p_partkey") * 37).alias("t")).collect()}
    assert (whole[9729], whole[9730], whole[9_999_999], whole[None]) == ("99:59:33", "100:00:10", "102777:46:03", None)


def test_stream_is_idempotent(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "lake")
    raw = ref.synthetic_trades(spark, 300)
    raw.repartition(2).write.parquet(src)
    seen = []
    for checkpoint in ("c1", "c2"):
        q = stream.ingest_stream(stream.raw_stream(spark, src), root, str(tmp_path / checkpoint), on_batch=lambda n, w, c: seen.append(sum(r.row_count for r in w.collect())))
        q.awaitTermination()
    assert seen[0] == seen[1] == store.count(spark, root, "WDOJ26") > 250


def test_catalog_queries_equal_their_sql(spark):
    import duckdb
    from tidemill.plans import catalogue

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for q in ("error_category", "chunk_split", "job_progress", "symbol_density", "timing_percentiles", "resumable_job", "contract_probe", "partitions_of_job_or_symbol"):
        got = catalogue.QUERIES[q](spark, d).toPandas()
        want = con.sql(catalogue.ORACLE_SQL[q]).df()[list(got.columns)]
        by = list(got.columns)
        assert len(got) == len(want) > 0 and got.sort_values(by).round(9).astype(str).values.tolist() == want.sort_values(by).round(9).astype(got.dtypes.to_dict()).astype(str).values.tolist(), q


def test_retries_by_category():
    waits, calls = [], []
    retry = resilience.Retry(jitter=0.0, sleep=waits.append)

    def job(code, ok_at):
        calls.append(code)
        if len(calls) < ok_at:
            raise RuntimeError(code)
        return "done"

    of = lambda e: resilience.category_of(e.args[0])
    assert retry.run(lambda: job(-2147483647, 4), of) == "done" and waits == [30.0, 60.0, 120.0]
    for code, most in ((-2147483627, 3), (-2147483645, 1), (5, 1)):
        calls.clear()
        with pytest.raises(RuntimeError):
            retry.run(lambda c=code: job(c, 99), of)
        assert len(calls) == most
    tries = iter([([], 90.0), ([1], 99.0), ([2], 95.0)])
    assert resilience.best_of(lambda: next(tries)) == ([1], 99.0)


def test_circuit_breaker():
    now = [0.0]
    b = resilience.CircuitBreaker(threshold=2, window=10, cooldown=5, clock=lambda: now[0])

    def fail():
        raise OSError

    for t in (0.0, 20.0, 21.0):  # the first is out of the window by then
        now[0] = t
        with pytest.raises(OSError):
            b.call(fail)
    assert b.state == "open"
    with pytest.raises(resilience.CircuitOpen):
        b.call(int)
    now[0] = 27.0
    with pytest.raises(OSError):
        b.call(fail)  # the trial fails: twice the wait
    now[0] = 33.0
    assert b.state == "open"
    now[0] = 38.0
    assert b.call(int) == 0 and b.state == "closed"


def test_care_of_a_store(spark, tmp_path):
    root = str(tmp_path / "lake")
    t = ingest.dedup(ingest.sequence(trades(spark)))
    store.write(t.drop("arrival"), root)
    used = care.storage_used(spark, root).first()
    empty = lambda n: spark.createDataFrame([], catalog.TABLES[n][0])
    cache = care.checksums(spark, root, empty("_checksum_cache"))
    assert used.n_files == cache.count() > 0 and used.n_bytes == cache.agg(F.sum("file_size_bytes")).first()[0]
    marked = spark.createDataFrame(cache.withColumn("checksum_sha256", F.lit("kept")).collect(), cache.schema)
    assert {r.checksum_sha256 for r in care.checksums(spark, root, marked).collect()} == {"kept"}
    parts = care.register_missing(spark, root, empty("partitions"))
    assert parts.agg(F.sum("row_count")).first()[0] == t.count() and parts.count() == used.n_files
    assert care.register_missing(spark, root, parts).count() == used.n_files
    for bad in ("../lake", "/etc", "a/../../b", "", "file:/x"):
        with pytest.raises(ValueError, match="below the root"):
            care.delete_partition(spark, root, parts, bad)
    (tmp_path / "lake" / "x.tmp.parquet").write_bytes(b"x")
    assert care.remove_stale(spark, root) == [] and care.remove_stale(spark, root, 0) == ["x.tmp.parquet"]
    one = parts.first().partition_path
    kept = spark.createDataFrame(parts.collect(), parts.schema)
    assert care.delete_partition(spark, root, kept, one).count() == used.n_files - 1
    assert care.storage_used(spark, root).first().n_files == used.n_files - 1


def test_store_migration_and_rollback(spark, tmp_path):
    root = str(tmp_path / "lake")
    old = ingest.dedup(ingest.sequence(trades(spark))).drop("arrival")
    n = old.count()
    store.with_keys(old.drop("buy_agent_name", "sell_agent_name", "trade_type_name")).write.partitionBy(*store.KEYS).parquet(root)
    backup = care.migrate_store(spark, root, "1.0.0", run="a")
    new = store.scan(spark, root)
    assert new.count() == n and new.where("trade_type is not null and trade_type_name is null").isEmpty()
    care.rollback(spark, root, backup)
    assert "trade_type_name" not in spark.read.parquet(root).columns
    backup = care.migrate_store(spark, root, "1.0.0", run="b")
    assert care.clean_backups(spark, root) == [] and care.clean_backups(spark, root, 0) == ["lake.backup-b"] and store.exists(spark, root)
    with pytest.raises(ValueError, match="no backup"):
        care.rollback(spark, root, backup)


def test_health_and_conditional_compaction(spark, tmp_path):
    root = str(tmp_path / "lake")
    assert [r.passed for r in care.health(spark, root, 0).collect()] == [False, True, True, True]
    store.write(ingest.dedup(ingest.sequence(trades(spark))).drop("arrival"), root)
    assert all(r.passed for r in care.health(spark, root, 0).collect())
    assert [r.check for r in care.health(spark, root, 1 << 62).where("not passed").collect()] == ["space"]
    day = date(2023, 11, 14)
    days = spark.createDataFrame([(day,)], "day date")
    ledger = lambda status: spark.createDataFrame([("WDOJ26", "F", day, "j", status, 5, None)], catalog.TABLES["chunk_ledger"][0])
    none = spark.createDataFrame([], catalog.TABLES["compactions"][0])
    month = ("F", "WDOJ26", 2023, 11, days)
    assert care.compact_if_complete(spark, root, str(tmp_path / "m"), *month, ledger("failed"), none)[0] is None
    n, log = care.compact_if_complete(spark, root, str(tmp_path / "m"), *month, ledger("completed"), none)
    assert n == store.count(spark, root, "WDOJ26") > 0 and [(r.symbol, r.status) for r in log.collect()] == [("WDOJ26", "completed")]


def test_stream_keeps_bad_rows_out(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "lake")
    raw = ref.synthetic_trades(spark, 300)
    k = F.col("arrival")
    bad = raw.withColumn("price", F.when(k == 7, float("nan")).when(k == 8, -1.0).otherwise(F.col("price"))).withColumn("quantity", F.when(k == 20, -5).otherwise(F.col("quantity")))
    bad = bad.withColumn("exchange", F.when(k == 30, "Q").otherwise(F.col("exchange"))).withColumn("timestamp_ns", F.when(k == 40, -1).otherwise(F.col("timestamp_ns"))).withColumn("flags", F.when(k == 50, 1).otherwise(F.col("flags")))
    bad.coalesce(1).write.parquet(src)
    seen = []
    for checkpoint in ("c1", "c2"):  # the second run replays the batch
        q = stream.ingest_stream(stream.raw_stream(spark, src), root, str(tmp_path / checkpoint), on_batch=lambda n, w, c: seen.append((n, c)), clock=lambda: 123)
        q.awaitTermination()
    assert seen == [(0, {"sentinel_skips": 1, "invalid_price_skips": 1, "edits": 1, "quarantined": 3})] * 2
    stored = store.scan(spark, root)
    assert stored.where("exchange not in ('F', 'B') or price <= 0 or isnan(price) or quantity <= 0 or ingestion_ts_ns <> 123").isEmpty()
    away = spark.read.parquet(f"{root}.quarantine")
    assert {(r.violation, r.arrival) for r in away.collect()} == {("price", 7), ("quantity", 20), ("exchange", 30)}
    book = stream.ledger(spark, root)
    assert book.agg(F.sum("trades_count")).first()[0] == 295 and {r.status for r in book.collect()} == {"completed"}
    q = stream.ingest_stream(stream.raw_stream(spark, src), str(tmp_path / "other"), str(tmp_path / "c3"), stop=lambda: True)
    with pytest.raises(Exception, match="before batch 0"):
        q.awaitTermination()
    assert not store.exists(spark, str(tmp_path / "other")) and stream.ledger(spark, str(tmp_path / "other")).count() == 0


def test_stored_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "catalog"))
    assert c.version() == "0" and c.migrate("1.1") == ["1.0", "1.1"] and c.migrate() == ["1.2", "1.3"] and c.migrate() == [] and c.version() == "1.3"
    a, b, now = datetime(2024, 1, 1), datetime(2024, 1, 31), datetime(2024, 2, 1, 9)
    c.register_job("j1", "WDOJ26", "F", a, b)
    with pytest.raises(ValueError, match="is registered"):
        c.register_job("j1", "WDOJ26", "F", a, b)
    with pytest.raises(ValueError, match="can't go"):
        c.update_job("j1", status="completed")
    c.update_job("j1", status="in_progress", started_at=now)
    assert c.resumable("WDOJ26", "F", a, b) == "j1" and c.resumable("WDOJ26", "F", a, now) is None
    c.update_job("j1", status="completed", completed_at=now, trades_count=5)
    assert c.job("j1").trades_count == 5 and c.job("j1").symbol == "WDOJ26" and c.job("nope") is None
    assert [r.job_id for r in c.jobs(["completed"]).collect()] == ["j1"] and c.jobs(["failed"]).count() == 0
    for name in ("x.parquet", "y.parquet", "z.parquet"):
        c.begin_partition(name, "j1", now)
    c.commit_partition({"partition_path": "x.parquet", "symbol": "WDOJ26", "row_count": 3, "job_id": "j1"})
    c.commit_partition({"partition_path": "x.parquet", "symbol": "WDOJ26", "row_count": 4})
    row = c.read("partitions").first()
    assert (row.row_count, row.job_id) == (4, "j1")
    assert c.recover_commits(spark.createDataFrame([("y.parquet",)], "partition_path string")) == ["y.parquet"] and c.read("_pending_commits").count() == 1
    c.register_gaps("WDOJ26", "F", [(b, now, "late"), (a, b, "missing")], now)
    assert [r.reason for r in c.gaps("WDOJ26").collect()] == ["missing", "late"]
    c.resolve_gap("WDOJ26", a, b, now)
    assert [r.reason for r in c.gaps(unresolved=True).collect()] == ["late"]
    for d, s in ((2, "completed"), (3, "failed"), (4, "no_trades")):
        c.record_chunk("WDOJ26", "F", date(2024, 1, d), "j1", s, 1, now)
    assert c.completed_days("WDOJ26", "F") == [date(2024, 1, 2), date(2024, 1, 4)]
    days = cal.business_days(spark, "2024-01-01", "2024-01-05", cal.holidays(spark))
    assert [r.day.day for r in c.resume_plan(days, "WDOJ26", "F").collect()] == [3, 5]
    c.add_contract(symbol_root="WDO", contract_code="WDOK26", vigent_from=date(2026, 4, 1), vigent_until=date(2026, 4, 30))
    c.add_contract(symbol_root="WDO", contract_code="WDOJ26", vigent_from=date(2026, 3, 1), vigent_until=date(2026, 3, 31), notes="n")
    assert [r.contract_code for r in c.contracts("WDO").collect()] == ["WDOJ26", "WDOK26"]
    with pytest.raises(ValueError, match="end before"):
        c.add_contract(symbol_root="WDO", contract_code="X", vigent_from=date(2026, 3, 2), vigent_until=date(2026, 3, 1))
    # a writer that broke off leaves no commit mark: the version before stays in force
    (tmp_path / "catalog" / "gaps" / "v99").mkdir()
    assert c.gaps().count() == 2


def test_a_killed_compaction_is_recovered(spark, tmp_path, monkeypatch):
    lake, months, c = str(tmp_path / "lake"), tmp_path / "months", Catalog(spark, str(tmp_path / "catalog"))
    store.write(ingest.dedup(ingest.sequence(trades(spark))).drop("arrival"), lake)
    day, now = date(2023, 11, 14), datetime(2024, 1, 1)
    days = spark.createDataFrame([(day,)], "day date")
    out_of = lambda s, e, y, m: str(months / f"{e}-{s}-{y}-{m}")
    key = ("WDOJ26", "F", 2023, 11)
    run = lambda: c.compact(lake, out_of(*key), "F", "WDOJ26", 2023, 11, days, now)
    assert run() is None and c.read("compactions").count() == 0  # the ledger lacks the day
    c.record_chunk("WDOJ26", "F", day, "j", "completed", 5, now)
    whole = store.compact

    def dies_before(*a):
        raise KeyboardInterrupt

    def dies_after(*a):
        whole(*a)
        raise KeyboardInterrupt

    for job, action, status in ((dies_before, "revert", "reverted"), (dies_after, "complete", "completed")):
        monkeypatch.setattr(store, "compact", job)
        with pytest.raises(KeyboardInterrupt):
            run()
        assert [r.status for r in c.read("compactions").collect()] == ["in_flight"]
        assert c.recover_compactions(lake, out_of, now) == {key: action}
        assert [r.status for r in c.read("compactions").collect()] == [status] and store.exists(spark, out_of(*key)) == (action == "complete")
    monkeypatch.setattr(store, "compact", whole)
    assert run() == store.count(spark, lake, "WDOJ26") and c.recover_compactions(lake, out_of, now) == {}


def test_compacted_months_are_scanned(spark, tmp_path, monkeypatch):
    lake, out = str(tmp_path / "lake"), str(tmp_path / "month")
    c, now, key = Catalog(spark, str(tmp_path / "catalog")), datetime(2024, 1, 1), ("WDOJ26", "F", 2023, 11)
    t = ingest.dedup(ingest.sequence(trades(spark)))
    later = t.limit(5).withColumn("timestamp_ns", F.col("timestamp_ns") + 40 * tu.DAY_NS)  # 2023-12-24
    store.write(t.unionByName(later).drop("arrival"), lake)
    n = t.count()
    days = spark.createDataFrame([(date(2023, 11, 14),)], "day date")
    c.record_chunk("WDOJ26", "F", date(2023, 11, 14), "j", "completed", n, now)
    before = store.read(spark, lake, "WDOJ26", date(2023, 11, 14), date(2023, 11, 14)).collect()
    run = lambda: c.compact(lake, out, "F", "WDOJ26", 2023, 11, days, now, replace=True)
    whole, moved = store.adopt, []

    def dies(*a, **k):
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "adopt", dies)  # after the month was written, before it took the days' place
    with pytest.raises(KeyboardInterrupt):
        run()
    monkeypatch.setattr(store, "adopt", whole)
    assert store.count(spark, lake, "WDOJ26") == n + 5 and not store.adopted(spark, lake, "F", "WDOJ26", 2023, 11)
    assert c.recover_compactions(lake, lambda *k: out, now, replace=True) == {key: "complete"}
    assert store.adopted(spark, lake, "F", "WDOJ26", 2023, 11) and not store.exists(spark, out)
    with pytest.raises(ValueError):
        whole(spark, lake, out, "F", "WDOJ26", 2023, 11)  # nothing to move, so nothing is deleted
    monkeypatch.setattr(store, "adopt", lambda *a: moved.append(whole(*a)) or dies())  # after the move, before the mark is closed
    with pytest.raises(KeyboardInterrupt):
        run()
    assert moved and c.recover_compactions(lake, lambda *k: out, now, replace=True) == {key: "complete"}

    read = lambda a, b: store.read(spark, lake, "WDOJ26", a, b)
    assert read(date(2023, 11, 14), date(2023, 11, 14)).collect() == before and len(before) == n
    assert read(date(2023, 11, 15), date(2023, 11, 30)).count() == 0 and read(date(2023, 11, 1), date(2023, 12, 31)).count() == n + 5
    with pytest.raises(ValueError):
        store.write(t.drop("arrival"), lake)
    store.write(later.drop("arrival"), lake)
    store.merge_write(t, lake)  # stored trades win
    assert store.count(spark, lake, "WDOJ26") == n + 5
    written = store.merge_write(t.limit(3).withColumn("timestamp_ns", F.col("timestamp_ns") + tu.DAY_NS), lake).collect()
    assert [(r.month, r.day, r.row_count) for r in written] == [(11, store.MONTH, n + 3)]
    assert read(date(2023, 11, 15), date(2023, 11, 15)).count() == 3 and store.adopted(spark, lake, "F", "WDOJ26", 2023, 11)


def test_ties_and_nested_contracts(spark):
    c = spark.createDataFrame([("R", "A", date(2024, 1, 1), date(2024, 1, 31)), ("R", "B", date(2024, 1, 5), date(2024, 1, 10)), ("R", "C", date(2024, 1, 11), date(2024, 2, 10))], "symbol_root string, contract_code string, vigent_from date, vigent_until date")
    got = sorted((r.contract_code, r.lo, r.hi) for r in co.slices(c, 0, tu.MAX_NS).collect())
    assert [x[0] for x in got] == ["A", "C"] and got[1][1] == got[0][2] + 1
    at = [("A", datetime(2024, 1, 15)), ("C", datetime(2024, 2, 5)), ("C", datetime(2024, 2, 5)), ("C", datetime(2024, 2, 6))]
    t = spark.createDataFrame([(s, tu.to_ns(x), 0, float(i)) for i, (s, x) in enumerate(at)], "symbol string, timestamp_ns long, sequence_within_ns int, price double")
    assert sum(r._rollover_event for r in co.read_continuous(t, c, "R", 0, tu.MAX_NS).collect()) == 1


def test_integrity_severities_and_stored_order(spark):
    t = ingest.dedup(ingest.sequence(trades(spark, 50))).withColumn("ingestion_ts_ns", F.col("timestamp_ns")).withColumn("row", F.when(F.col("arrival") == 3, 40).otherwise(F.col("arrival")))
    lines = {r.check: r for r in integrity.report(t, physical=(["row"], ["symbol"]), versions=["0"]).collect()}
    assert not lines["INT-3"].passed and lines["INT-11"].n_bad == t.count() and lines["INT-4"].passed
    assert integrity.report(t, versions=["t"]).where("not passed").isEmpty()
    parts = spark.createDataFrame([("a", "1", "1.1.0", 1, 2)], "partition_path string, checksum_sha256 string, schema_version string, first_ts_ns long, last_ts_ns long")
    files = lambda *rows: spark.createDataFrame(rows, "partition_path string, checksum_sha256 string")
    of = lambda f: {r.check: (r.severity, r.passed) for r in integrity.report(t, parts, f).collect()}
    assert of(files(("a", "1"), ("b", "2")))["INT-6"] == ("high", False)
    assert of(files(("a", "x"), ("b", "2")))["INT-6"] == ("critical", False) and of(files(("a", "x")))["INT-7"] == ("critical", False)


def test_error_code_alone():
    assert resilience.category_of(-1) == resilience.category_of(0) == "permanent" and resilience.category_of(7) == "unknown"


def test_footers_hold_the_schema_version(spark, tmp_path):
    root, bare = str(tmp_path / "lake"), str(tmp_path / "bare")
    t = store.prepare(trades(spark, 40), ingested_ns=1, version="t").withColumn("symbol", F.lit("A%20B"))
    store.write(t.drop("arrival"), root)
    assert {r.schema_version for r in store.versions(spark, root).collect()} == {schema.VERSION}
    assert store.scan(spark, root).count() == t.count()
    lines = integrity.report(t, footers=store.versions(spark, root))
    assert lines.where("check = 'INT-1' and passed").count() == 1
    t.write.parquet(bare)
    assert integrity.report(t, footers=store.versions(spark, bare)).where("check = 'INT-1' and not passed").count() == 1


def test_average_and_filling_by_parts(spark):
    minute = 60_000_000_000
    rows = [("a", day * 1440 * minute + m * minute + k, k, float(day + m % 7 + k)) for day in (1, 2, 9) for m in (5, 6, 700) for k in range(4)] + [("b", 3 * minute, 0, 2.0)]
    t = spark.createDataFrame(rows, "symbol string, timestamp_ns long, sequence_within_ns int, price double").withColumn("quantity", F.lit(1))
    for r in an.ema(t).collect():
        e = None
        for x in sorted(x for x in rows if x[0] == r.symbol and x[1] // (1440 * minute) == (r.day - r.day.fromtimestamp(0)).days):
            e = x[3] if e is None else 2 / 21 * x[3] + 19 / 21 * e
        assert r.ema == pytest.approx(e, rel=1e-12)
    for size in (minute, 7 * minute):
        closes = {(x[0], x[1] // size * size): x[3] for x in sorted(rows)}
        expected = {}
        for s in "ab":
            at = [k[1] for k in closes if k[0] == s]
            for b in range(min(at), max(at) + 1, size):
                expected[s, b] = closes.get((s, b), expected.get((s, b - size)))
        assert {(r.symbol, r.bar_ns): r.close for r in an.resample_ffill(t, size).collect()} == expected


def test_progress_switch_and_metrics(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "lake")
    ref.synthetic_trades(spark, 200).repartition(2).write.parquet(src)
    now, seen = [0.0], []
    watch, meter, switch = Progress(total=2, clock=lambda: now[0]), Registry({"stream_batch_seconds": (0.0, 1e6)}), Switch()
    watch.observe(lambda e: 1 / 0)
    off = watch.observe(seen.append)
    stream.ingest_stream(stream.raw_stream(spark, src, 1), root, str(tmp_path / "c"), stop=switch, progress=watch, metrics=meter).awaitTermination()
    assert [e.done for e in seen] == [1, 2] and seen[-1].eta_s == 0 and seen[-1].trades == 200
    text = meter.render().splitlines()
    assert 'stream_trades_total{job="stream"} 200' in text and 'stream_batch_seconds_bucket{job="stream",le="+Inf"} 2' in text and 'stream_batch_seconds_count{job="stream"} 2' in text
    off()
    watch.flush()
    assert len(seen) == 2
    some = Progress(total=10, clock=lambda: now[0])
    some.observe(seen.append)
    for now[0] in (1.0, 1.2, 1.4, 1.6):
        some.batch(5)
    assert [(e.done, e.trades) for e in seen[2:]] == [(1, 5), (4, 20)] and seen[-1].eta_s == pytest.approx(6 * 1.6 / 4)
    switch.pause()
    switch.cancel()
    assert switch() is True
    with pytest.raises(ValueError):
        meter.gauge("stream_trades_total", 1)
    with pytest.raises(ValueError):
        meter.count("x", -1)


def test_secrets_are_blanked(spark):
    rows = [("u", "p", 7, {"Token": "t", "a": "b"}, [("x", "y")], None), (None, None, None, None, None, ("k", 1))]
    df = spark.createDataFrame(rows, "user string, `nl.Password` string, token_no int, m map<string,string>, l array<struct<api_key:string,b:string>>, s struct<secret:string,n:int>")
    a, b = redact(df).collect()
    assert (a.user, a["nl.Password"], a.token_no, a.m, a.s) == ("u", BLANK, None, {"Token": BLANK, "a": "b"}, None)
    assert (a.l[0].api_key, a.l[0].b) == (BLANK, "y") and b["nl.Password"] is None and (b.s.secret, b.s.n) == (BLANK, 1) and b.m is None
    assert redact(df, allowed=("token_no",)).first().token_no == 7 and redact(df).schema.simpleString() == df.schema.simpleString()
