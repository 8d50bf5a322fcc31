"""One query per operator; each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tablecheck as tc
from tablecheck.functions import render_date
from tablecheck.session import pin, scratch_path
from tablecheck.sources.archives import unpack, unpacked_tables
from workloads.snapshots import (
    CUSTOMER_TYPES,
    NATION_TYPES,
    ORDER_TYPES,
    as_text,
    changed_orders,
    contract_json,
    iso,
    new_events,
    new_lines,
    new_orders,
    old_events,
    old_lines,
    old_orders,
    orders,
    table,
    with_null_keys,
    write_contract,
    zipped,
)

KEY = ["o_orderkey"]
LINE_KEY = ["l_orderkey", "l_linenumber"]
FROM, TO = "1996-01-01", "1997-12-31"
SAMPLE = tc.Sample(0.10)


def _orders(spark: SparkSession, d: str, **options) -> tc.Reconciliation:
    return tc.reconcile(old_orders(spark, d), new_orders(spark, d), KEY, **options)


def reconcile_rows(spark, d):
    return _orders(spark, d).rows


def reconcile_keep_equal(spark, d):
    return _orders(spark, d, keep_equal=True).rows


def reconcile_digest_first(spark, d):
    """Only keys and digests of all rows move; whole rows move where the digests differ."""
    return _orders(spark, d, digest_first=True).rows


def reconcile_unique_keys(spark, d):
    """The keys are declared unique, so they are not counted first."""
    return _orders(spark, d, unique_keys=True).rows


TEXT_KEYS = ["o_orderkey", "o_orderdate", "o_orderpriority"]


def reconcile_text_keys(spark, d):
    """Several text keys: a hash of them is compared before the texts."""
    old, new = as_text(orders(spark, d)), as_text(changed_orders(spark, d))
    result = tc.reconcile(old, new, TEXT_KEYS, numeric_cols=["o_totalprice", "o_custkey"])
    return _priced(result.rows)


def reconcile_numeric_only(spark, d):
    return _orders(spark, d, numeric_only=True).rows


def _priced(rows: DataFrame) -> DataFrame:
    """Prices that are reported as text, as numbers: engines print some doubles differently."""
    names = ("O_TOTALPRICE_OLD", "O_TOTALPRICE_NEW")
    return rows.withColumns({n: F.col(n).cast("double") for n in names})


def reconcile_text_numbers(spark, d):
    """Both versions as text, as from files without types; numbers still within tolerance."""
    old, new = as_text(orders(spark, d)), as_text(changed_orders(spark, d))
    return _priced(tc.reconcile(old, new, KEY, numeric_cols=["o_totalprice"]).rows)


def reconcile_null_keys(spark, d):
    old, new = with_null_keys(old_orders(spark, d)), with_null_keys(new_orders(spark, d))
    return tc.reconcile(old, new, ["o_orderkey", "ref"]).rows


def reconcile_null_key_text(spark, d):
    old, new = with_null_keys(old_orders(spark, d)), with_null_keys(new_orders(spark, d))
    result = tc.reconcile(old, new, ["o_orderkey", "ref"], value_cols=["o_totalprice"])
    return result.report(null_key_text="(none)")


def reconcile_duplicate_keys(spark, d):
    return tc.reconcile(old_lines(spark, d), new_lines(spark, d), LINE_KEY).rows


def reconcile_duplicate_keep_equal(spark, d):
    old, new = old_lines(spark, d), new_lines(spark, d)
    return tc.reconcile(old, new, LINE_KEY, keep_equal=True).rows


def reconcile_duplicate_fanout(spark, d):
    old, new = old_lines(spark, d), new_lines(spark, d)
    return tc.reconcile(old, new, LINE_KEY, on_duplicates="fanout").rows


def reconcile_few_duplicates(spark, d):
    """Repeating keys are few here, so only their rows are paired copy by copy."""
    return tc.reconcile(old_events(spark, d), new_events(spark, d), ["event_id"]).rows


def _keyless(df: DataFrame) -> DataFrame:
    return with_null_keys(df).drop("ref")


def reconcile_hot_key(spark, d):
    """Two thirds of the rows share the null key, which is numbered in ranges."""
    old, new = _keyless(old_orders(spark, d)), _keyless(new_orders(spark, d))
    return tc.reconcile(old, new, KEY, hot_rows=1000).rows


def duplicate_key_report(spark, d):
    return tc.duplicate_keys(table(spark, d, "lineitem"), LINE_KEY)


def duplicate_keys_both_sides(spark, d):
    return tc.reconcile(old_lines(spark, d), new_lines(spark, d), LINE_KEY).duplicate_keys


def mismatch_counts(spark, d):
    return _orders(spark, d).mismatch_counts


def key_null_counts(spark, d):
    old, new = with_null_keys(old_orders(spark, d)), with_null_keys(new_orders(spark, d))
    return tc.null_key_counts(old, new, ["o_orderkey", "ref"])


def one_sided_rows(spark, d):
    return _orders(spark, d).rows.filter("_SIDE <> 'both'").select("O_ORDERKEY", "_SIDE")


def shape_and_summary(spark, d):
    old = old_orders(spark, d)
    new = new_orders(spark, d).withColumn("o_custkey", F.col("o_custkey").cast("decimal(20,0)"))
    return tc.reconcile(old, new, KEY).summary


def _dated(df: DataFrame, form: str) -> DataFrame:
    """Dates as text: compact where the customer number is even, else in ``form``."""
    compact = F.regexp_replace("o_orderdate", "-", "")
    other = F.date_format(F.to_date("o_orderdate"), form)
    return df.withColumn(
        "o_orderdate", F.when(F.col("o_custkey") % 2 == 0, compact).otherwise(other)
    )


def reconcile_date_range(spark, d):
    old = _dated(old_orders(spark, d), "yyyy-MM-dd")
    new = _dated(new_orders(spark, d), "yyyy-MM-dd HH:mm:ss")
    return tc.reconcile(
        old, new, ["o_orderkey", "o_orderdate"], date_cols=["o_orderdate"],
        date_range=("o_orderdate", FROM, TO),
    ).rows


def date_range_rows(spark, d):
    """On a timestamp column the range reaches the scan."""
    rows = tc.in_date_range(table(spark, d, "orders"), "o_orderdate", FROM, TO)
    return rows.select("o_orderkey", iso("o_orderdate").alias("o_orderdate"))


def _event_dates(spark, d) -> DataFrame:
    """Event times as text in four forms, one of which is no date."""
    form = F.col("event_id") % 4
    text = (
        F.when(form == 0, F.date_format("ts", "yyyyMMdd"))
        .when(form == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(form == 2, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.date_format("ts", "dd/MM/yyyy"))
    )
    return table(spark, d, "events").select("event_id", text.alias("day"))


def date_standardize(spark, d):
    dates = tc.standardize_dates(_event_dates(spark, d), ["day"])
    return dates.select("event_id", render_date(F.col("day")).alias("day"))


def unparsed_dates(spark, d):
    return tc.unparsed_dates(_event_dates(spark, d), ["day"])


def date_max(spark, d):
    compact = table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyyMMdd").alias("cut_off")
    )
    return tc.latest_date(compact, "cut_off")


def hash_sample(spark, d):
    return tc.sample_rows(orders(spark, d), KEY, SAMPLE)


def stratified_counts(spark, d):
    return tc.strata(table(spark, d, "orders"), "o_orderstatus", KEY, SAMPLE.fraction)


def reconcile_sampled(spark, d):
    return _orders(spark, d, sample=SAMPLE).rows


def reconcile_from_files(spark, d):
    old, new = scratch_path(spark, "old") + ".csv", scratch_path(spark, "new")
    orders(spark, d).write.option("header", True).csv(old, sep=";")
    changed_orders(spark, d).write.parquet(new)
    return _priced(tc.reconcile_files(spark, old, new, KEY, header=True).rows)


def report_roundtrip(spark, d):
    path = scratch_path(spark, "report")
    result = _orders(spark, d)
    result.write_report(path, ordered=True)
    return tc.read_table(
        spark, path, fmt="csv", sep=",", header=True, schema=result.rows.schema
    )


def stamped_report(spark, d):
    """The report under a path with the run's time, found again by its beginning."""
    path = scratch_path(spark, "stamped")
    result = _orders(spark, d)
    result.write_report(path, stamped=True)
    return tc.read_table(
        spark, f"{path}_*", fmt="csv", sep=",", header=True, schema=result.rows.schema
    )


def verdicts(spark, d):
    """What whole checks say of a table and itself, its second version, and half of it."""
    old, new = old_orders(spark, d), new_orders(spark, d)
    cases = {"same": (old, old), "changed": (old, new), "half": (old, old.where("o_orderkey % 2 = 0"))}
    rows = []
    for name, pair in cases.items():
        result = tc.reconcile(*pair, KEY, strict_shape=False)
        try:
            totals = result.assert_equal()
            rows.append((name, True, totals["rows_left"], totals["rows_right"]))
        except AssertionError:
            rows.append((name, False, result.profile.rows_left, result.profile.rows_right))
    return spark.createDataFrame(rows, "pair string, equal boolean, rows_left long, rows_right long")


def reconcile_text_codes(spark, d):
    """Text columns of files without types: numbers within the tolerance, codes and long ids exactly."""
    key, cents = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,5)")
    long_id = F.lit(9007199254740992).cast("long") + key

    def version(ids, letter, price, padded):
        return orders(spark, d).select(
            key.cast("string").alias("k"), ids.cast("string").alias("id"),
            F.concat("o_custkey", F.when(key % 5 == 0, letter).otherwise("d")).alias("code"),
            price.cast("decimal(18,5)").cast("string").alias("price"),
            F.concat(F.when(key % 3 == 0, padded).otherwise("00"), "o_custkey").alias("padded"),
        )

    moved = F.when(key % 7 == 0, F.lit("0.00001")).when(key % 11 == 0, F.lit("0.01")).otherwise("0")
    frames = {
        "old": version(long_id, "d", cents, "00"),
        "new": version(long_id + F.when(key % 4 == 0, 1).otherwise(0), "f", cents + moved.cast("decimal(18,5)"), ""),
    }
    base = scratch_path(spark, "codes")
    for name, df in frames.items():
        tc.write_rows(df, f"{base}/{name}.csv")
    return tc.reconcile_files(spark, f"{base}/old.csv", f"{base}/new.csv", ["k"], sep=",", header=True).rows


def reconcile_near_copies(spark, d):
    """Copies whose values are moved by less than the tolerance, in another order; some
    are moved by more. How many rows are reported of each key."""
    part, near = F.col("l_partkey"), F.col("l_linenumber")
    base = F.floor(F.col("l_extendedprice") / 1000) * 1000.0
    old = table(spark, d, "lineitem").select(
        "l_orderkey", near.alias("line"), (base + part % 3 * 0.00001).alias("price")
    )
    changed = F.when(part % 11 == 0, base + 500.0).otherwise(base + part % 4 * 0.00001)
    new = table(spark, d, "lineitem").select("l_orderkey", near.alias("line"), changed.alias("price"))
    rows = tc.reconcile(old, new, ["l_orderkey"]).rows
    return rows.groupBy("L_ORDERKEY").agg(F.count("*").alias("reported"))


def reconcile_noisy_copies(spark, d):
    """As ``reconcile_near_copies``, with values moved by up to 0.95 of the tolerance, so that
    many copies lie near the edge of it. How many rows are reported of each key."""
    part = F.col("l_partkey")
    base = F.floor(F.col("l_extendedprice") / 1000) * 1000.0 + 0.00004
    lines = table(spark, d, "lineitem").withColumn("line", F.col("l_linenumber"))
    old = lines.select("l_orderkey", "line", base.alias("price"))
    moved = F.when(part % 11 == 0, base + 500.0).otherwise(base + part % 20 * 0.000005)
    new = lines.select("l_orderkey", "line", moved.alias("price"))
    rows = tc.reconcile(old, new, ["l_orderkey"]).rows
    return rows.groupBy("L_ORDERKEY").agg(F.count("*").alias("reported"))


def _ingested(spark, tables: dict[str, tuple[DataFrame, dict]]) -> dict[str, DataFrame]:
    """Tables as delimited files, read back and written under a contract."""
    base = scratch_path(spark, "ingest")
    contract = {}
    for name, (df, types) in tables.items():
        df.write.option("header", True).csv(f"{base}/{name}.csv", sep=";")
        contract[name] = contract_json(df, types, nullable={"o_custkey"})
    write_contract(spark, contract, f"{base}/contract")
    raw = tc.read_raw_tables(spark, [f"{base}/{name}.csv" for name in tables])
    tc.ingest(raw, tc.read_contract(spark, f"{base}/contract"), f"{base}/out")
    return {name: spark.read.parquet(f"{base}/out/{name}") for name in tables}


def contract_ingest(spark, d):
    return _ingested(spark, {"orders": (orders(spark, d), ORDER_TYPES)})["orders"]


def contract_tables(spark, d):
    tables = _ingested(
        spark,
        {
            "customer": (table(spark, d, "customer"), CUSTOMER_TYPES),
            "nation": (table(spark, d, "nation"), NATION_TYPES),
        },
    )
    customer = tables["customer"].select(
        F.lit("customer").alias("source"), F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
    )
    nation = tables["nation"].select(
        F.lit("nation"), "n_nationkey", "n_name", F.lit(None).cast("double")
    )
    return customer.union(nation)


def archive_ingest(spark, d):
    """Orders packed into zip archives by the tasks, then unpacked and typed."""
    base = scratch_path(spark, "archive")
    rows = orders(spark, d)
    contract = {"orders": contract_json(rows, ORDER_TYPES, nullable=set())}
    write_contract(spark, contract, f"{base}/contract")
    raw = unpacked_tables(unpack(zipped(rows, "orders.v1")))
    tc.ingest(raw, tc.read_contract(spark, f"{base}/contract"), f"{base}/out")
    return spark.read.parquet(f"{base}/out/orders")


def contract_violations(spark, d):
    """Orders with empty and unreadable cells put in."""
    base = scratch_path(spark, "broken")
    key = F.col("o_orderkey")
    broken = as_text(orders(spark, d)).select(
        "o_orderkey",
        F.when(key % 5 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(key % 17 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 19 == 0, "abc").otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(key % 23 == 0, F.regexp_replace("o_orderdate", "-", "/"))
        .otherwise(F.col("o_orderdate")).alias("o_orderdate"),
        F.when(key % 29 == 0, "N/A").otherwise(F.col("o_orderpriority"))
        .alias("o_orderpriority"),
    )
    contract = {"orders": contract_json(broken, ORDER_TYPES, nullable={"o_custkey"})}
    write_contract(spark, contract, f"{base}/contract")
    broken.write.option("header", True).csv(f"{base}/orders.csv", sep=";")
    raw = tc.read_raw_tables(spark, [f"{base}/orders.csv"])
    return tc.violations(raw, tc.read_contract(spark, f"{base}/contract"))


def partitioned_write(spark, d):
    path = scratch_path(spark, "by-status")
    tc.write_partitioned(orders(spark, d), path, ["o_orderstatus"])
    return spark.read.parquet(path)


def tokenize_pages(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    return tc.tokenize_text(pages, "html")


TERMS = tc.TokenStyle(terms=("utm_source", "http"))


def tokenize_terms(spark, d):
    return tc.tokenize_text(table(spark, d, "pages").select("page_id", "url"), "url", TERMS)


def tokenize_all_terms(spark, d):
    style = tc.TokenStyle(terms=TERMS.terms, require_underscore=False, salt="s-", width=12)
    return tc.tokenize_text(table(spark, d, "pages").select("page_id", "url"), "url", style)


def term_presence(spark, d):
    return tc.term_presence(table(spark, d, "pages"), "url", [*TERMS.terms, "nowhere_at_all"])


def token_dictionary(spark, d):
    """Written as JSON lines and read back."""
    path = scratch_path(spark, "dictionary")
    tc.write_dictionary(tc.term_dictionary(table(spark, d, "pages"), "html"), path)
    return tc.read_dictionary(spark, path)


def token_collisions(spark, d):
    style = tc.TokenStyle(width=3)
    return tc.token_collisions(tc.term_dictionary(table(spark, d, "pages"), "html", style))


def _restored(spark, d, strategy: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "html")
    dictionary = pin(tc.term_dictionary(pages, "html"), "dictionary")
    tokenized = tc.tokenize_text(pages, "html")
    return tc.restore_text(tokenized, "html", dictionary, ["page_id"], strategy=strategy)


def restore_pages(spark, d):
    return _restored(spark, d, "auto")


def restore_pages_by_join(spark, d):
    """As with a dictionary too large to travel to the texts."""
    return _restored(spark, d, "join")


def restore_urls(spark, d):
    urls = table(spark, d, "pages").select("page_id", "url")
    dictionary = pin(tc.term_dictionary(urls, "url", TERMS), "dictionary")
    return tc.restore_text(
        tc.tokenize_text(urls, "url", TERMS), "url", dictionary, ["page_id"], TERMS
    )


def round_trip(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    failed = tc.round_trip_failures(
        pages, "html", ["page_id"], pin(tc.term_dictionary(pages, "html"), "dictionary")
    )
    texts, failures = pages.agg(F.count("*")), failed.agg(F.count("*"))
    return (
        texts.select(F.lit("texts").alias("what"), F.col("count(1)").alias("n"))
        .union(failures.select(F.lit("failures"), "count(1)"))
    )


def text_files(spark, d):
    """Tokenised urls as plain text files, one line each."""
    path = scratch_path(spark, "texts")
    urls = table(spark, d, "pages").select("url")
    tc.write_texts(tc.tokenize_text(urls, "url", TERMS), path)
    return spark.read.text(path).select(F.col("value").alias("url"))


def whole_texts(spark, d):
    """The same files read whole: how many files hold text, and the characters in all."""
    path = scratch_path(spark, "texts")
    tc.write_texts(table(spark, d, "pages").select("url"), path)
    return tc.read_texts(spark, path).agg(F.sum(F.length("text")).alias("characters"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        reconcile_rows, reconcile_keep_equal, reconcile_digest_first, reconcile_unique_keys,
        reconcile_text_keys, reconcile_numeric_only, reconcile_text_numbers,
        reconcile_null_keys, reconcile_null_key_text, reconcile_duplicate_keys,
        reconcile_duplicate_keep_equal, reconcile_duplicate_fanout, reconcile_few_duplicates, reconcile_hot_key,
        duplicate_key_report,
        duplicate_keys_both_sides, mismatch_counts, key_null_counts, one_sided_rows,
        shape_and_summary, reconcile_date_range, date_range_rows, date_standardize,
        unparsed_dates, date_max, hash_sample, stratified_counts, reconcile_sampled,
        reconcile_from_files, reconcile_text_codes, reconcile_near_copies, reconcile_noisy_copies, verdicts, stamped_report,
        report_roundtrip, contract_ingest, contract_tables,
        archive_ingest, contract_violations, partitioned_write, tokenize_pages, tokenize_terms,
        tokenize_all_terms, term_presence, token_dictionary, token_collisions, restore_pages,
        restore_pages_by_join,
        restore_urls, round_trip, text_files, whole_texts,
    )
}
