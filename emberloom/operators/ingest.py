"""Ingest: pages read with cursors, ledgers, promotion and quarantine of staged records, label updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberloom.operators.merge import row_hash, staged

#: Most items and pages of one name search.
NAME_ITEMS, NAME_PAGES = 500, 5


def page_signature(items: str = "items") -> Column:
    """What tells that a server repeats a page: its items' keys in order."""
    return F.when(F.size(items) > 0, F.sha2(F.to_json(items), 256))


def read_pages(pages: DataFrame, rows_per_page: int, max_pages: int, start: str | None = None) -> DataFrame:
    """pages (source, page_no, items array, total, failed) as a server would give them -> those that a run reads.

    A run reads a source's pages from its cursor on (column start, else 1), at
    most max_pages, up to the first that fails, is a repeat of an earlier one
    (which is dropped), is short, or reaches the total. state tells 'page',
    'failed' or 'last'.
    """
    first = F.coalesce(F.col(start), F.lit(1)) if start else F.lit(1)
    wanted = pages.withColumn("_first", first).where((F.col("page_no") >= F.col("_first")) & (F.col("page_no") < F.col("_first") + max_pages))
    signed = wanted.withColumn("_sign", page_signature())
    seen = signed.where("_sign is not null").groupBy("source", "_sign").agg(F.min("page_no").alias("_seen"))
    repeat = F.coalesce(F.col("page_no") > F.col("_seen"), F.lit(False))
    short = (F.size("items") < rows_per_page) | F.coalesce(F.col("page_no") * rows_per_page >= F.col("total"), F.lit(False))
    failed = F.coalesce("failed", F.lit(False))
    state = F.when(failed, "failed").when(repeat, "repeat").when(short, "last").otherwise("page")
    judged = signed.join(seen, ["source", "_sign"], "left").withColumn("state", state)
    # a gap in the pages ends the run as well
    stop = judged.groupBy("source").agg(F.min(F.when(F.col("state") != "page", F.col("page_no"))).alias("_stop"), F.min("_first").alias("_from"), F.count("*").alias("_n"))
    read = judged.join(stop, "source").where((F.col("page_no") <= F.coalesce("_stop", F.lit(2**31))) & (F.col("state") != "repeat"))
    return read.select("source", "page_no", F.size("items").alias("n_items"), "state")


def name_search(pages: DataFrame) -> DataFrame:
    """pages (name, page_no, items array<struct<number,...>>, total) -> (name, items, found, total, complete).

    Items are kept by number, the first of each, up to NAME_ITEMS over
    NAME_PAGES pages; a page that adds nothing ends the search. complete: the
    totals agree and are reached.
    """
    own = pages.where(F.col("page_no") <= NAME_PAGES)
    each = own.select("name", "page_no", F.posexplode("items").alias("pos", "item"))
    first = each.groupBy("name", F.col("item.number").alias("number")).agg(F.min(F.struct("page_no", "pos")).alias("at"))
    fresh = first.groupBy("name", F.col("at.page_no").alias("page_no")).agg(F.count("*").alias("added"))
    steps = own.select("name", "page_no", "total").join(fresh, ["name", "page_no"], "left").na.fill({"added": 0})
    order = Window.partitionBy("name").orderBy("page_no")
    sofar = order.rowsBetween(Window.unboundedPreceding, -1)
    done = steps.withColumns(
        {
            "_before": F.coalesce(F.sum("added").over(sofar), F.lit(0)),
            "_idle": F.coalesce(F.max((F.col("added") == 0).cast("int")).over(sofar), F.lit(0)),
            "_total": F.first("total").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    read = done.where((F.col("_idle") == 0) & (F.col("_before") < NAME_ITEMS) & F.coalesce(F.col("_before") < F.col("_total"), F.lit(True)))
    totals = read.groupBy("name").agg(
        F.least(F.sum("added"), F.lit(NAME_ITEMS)).alias("found"), F.max("total").alias("total"), (F.min("total") == F.max("total")).alias("agree"), F.max("page_no").alias("last")
    )
    return totals.select("name", "found", F.greatest(F.coalesce("total", F.col("found")), F.col("found")).alias("total"), (F.coalesce("agree", F.lit(False)) & (F.col("found") == F.col("total"))).alias("complete"))


def cursors(current: DataFrame, read: DataFrame, rows_per_page: int) -> DataFrame:
    """Cursors (source, page, rows_per_page) after a run (see read_pages).

    A finished source loses its cursor, another continues behind its last good
    page (at the page that failed); a cursor of another page size starts anew.
    """
    ended = read.groupBy("source").agg(F.max(F.when(F.col("state") != "failed", F.col("page_no"))).alias("last"), F.max((F.col("state") == "last").cast("int")).alias("done"))
    joined = current.select("source", F.col("page").alias("_page"), F.col("rows_per_page").alias("_rows")).join(ended, "source", "full_outer")
    kept = F.when(F.col("_rows") == rows_per_page, F.col("_page")).otherwise(1)
    page = F.coalesce(F.col("last") + 1, kept, F.lit(1))
    return joined.where(F.coalesce("done", F.lit(0)) == 0).select("source", page.cast("int").alias("page"), F.lit(rows_per_page).alias("rows_per_page"))


def pending(files: DataFrame, ledger: DataFrame, name: str = "name") -> DataFrame:
    """Files that a ledger has not recorded, with their place in the order of names."""
    open_ = files.join(ledger.select(name), name, "left_anti")
    return open_.withColumn("place", F.row_number().over(Window.orderBy(name)))


def promoted(runtime: DataFrame, staging: DataFrame, key: str, owned: str) -> DataFrame:
    """What promoting staged records would do with each: inserted, unchanged, kept, conflict (other contents), owned_elsewhere (its image belongs to another record)."""
    state = staged(runtime, staging, key)
    owner = runtime.groupBy(owned).agg(F.min(key).alias("_owner"))
    image = staging.select(key, owned).join(owner, owned, "left").select(key, "_owner")
    joined = state.join(image, key, "left")
    elsewhere = F.col("_owner").isNotNull() & (F.col("_owner") != F.col(key))
    return joined.select(key, F.when(elsewhere, "owned_elsewhere").otherwise(F.col("state")).alias("state"))


def promotion(runtime: DataFrame, staging: DataFrame, key: str, owned: str, year: Column) -> tuple[DataFrame, DataFrame]:
    """(merged records, one row of counts and header); any conflict fails both before anything is written."""
    verdict = promoted(runtime, staging, key, owned)
    bad = verdict.where(F.col("state").isin("conflict", "owned_elsewhere")).agg(F.count("*").alias("n"), F.min(F.col(key).cast("string")).alias("k"))
    checked = bad.select(F.when(F.col("n") > 0, F.raise_error(F.concat(F.lit("cannot promote record "), F.col("k")))).otherwise(F.lit(True)).cast("boolean").alias("_ok"))
    fresh = staging.join(runtime.select(key), key, "left_anti")
    merged = runtime.unionByName(fresh).crossJoin(F.broadcast(checked)).where("_ok").drop("_ok")
    counts = verdict.agg(F.count_if(F.col("state") == "inserted").alias("new_records"), F.count_if(F.col("state") == "unchanged").alias("unchanged_records"))
    header = merged.agg(F.count("*").alias("records"), F.concat_ws(" ~ ", F.min(year).cast("string"), F.max(year).cast("string")).alias("years"))
    return merged, counts.crossJoin(F.broadcast(header))


def quarantined(tables: dict[str, DataFrame], key: str, value: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without a key's rows, and a manifest: rows before and removed, and a hash of all rows left, which does not depend on their order."""
    left, manifest = {}, None
    for name, table in tables.items():
        gone = F.coalesce(F.col(key) == value, F.lit(False))
        left[name] = table.where(~gone)
        digest = F.sum(F.when(~gone, F.conv(F.substring(row_hash(*table.columns), 1, 12), 16, 10).cast("decimal(20,0)")))
        part = table.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.count_if(gone).alias("removed"), digest.cast("string").alias("digest"))
        manifest = part if manifest is None else manifest.unionByName(part)
    return left, manifest


def labelled(rows: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels (keys, verdict, source, evidence) applied to rows (keys, verdict, source, confirmed, original).

    A model's label never changes a confirmed row: such a batch fails as a
    whole. A person's label confirms the row, and keeps the model's verdict
    that it replaces in original.
    """
    new = labels.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("verdict", "source", "evidence")])
    joined = rows.join(new, keys, "left")
    hit = F.col("_verdict").isNotNull()
    refused = joined.where(hit & (F.col("_source") == "llm") & F.coalesce(F.col("confirmed"), F.lit(False))).agg(F.count("*").alias("n"))
    bad = labels.where(~F.col("verdict").isin("유사", "비유사", "제외") | (F.coalesce(F.trim("evidence"), F.lit("")) == "")).agg(F.count("*").alias("b"))
    message = F.concat(F.lit("refused labels: "), (F.col("n") + F.col("b")).cast("string"))
    checked = refused.crossJoin(bad).select(F.when(F.col("n") + F.col("b") > 0, F.raise_error(message)).otherwise(F.lit(True)).cast("boolean").alias("_ok"))
    human = hit & (F.col("_source") == "human")
    out = joined.crossJoin(F.broadcast(checked)).where("_ok").withColumns(
        {
            "original": F.when(human & (F.col("source") == "llm") & (F.coalesce(F.col("verdict"), F.lit("")) != ""), F.col("verdict")).otherwise(F.col("original")),
            "verdict": F.coalesce("_verdict", "verdict"),
            "source": F.coalesce("_source", "source"),
            "confirmed": F.when(human, True).when(hit, False).otherwise(F.col("confirmed")),
        }
    )
    return out.select(*rows.columns)


def synced(records: DataFrame, plan: DataFrame, key: str, memo: str = "memo") -> DataFrame:
    """Records against a plan: outside it, memo to change, or the same."""
    p = plan.select(key, F.col(memo).alias("_memo"), F.lit(True).alias("_in"))
    state = F.when(F.col("_in").isNull(), "outside").when(~F.col(memo).eqNullSafe(F.col("_memo")), "memo_changed").otherwise("same")
    joined = records.join(p, key, "left")
    return joined.select(key, F.when(F.col("_in").isNotNull(), F.col("_memo")).otherwise(F.col(memo)).alias(memo), state.alias("state"))


def lookups(targets: DataFrame, existing: DataFrame, limit: int | None = None, retry_failed: bool = False, only_failed: bool = False) -> DataFrame:
    """targets (kind, number, pos) -> numbers still to be looked up, by kind and first place; existing (kind, number, result).

    Failed lookups ('0건', '오류') are done again if asked for; a limit runs over
    the kinds in order.
    """
    kinds = F.array(*[F.lit(k) for k in ("registration", "application", "international")])
    wanted = targets.where(F.array_contains(kinds, F.col("kind")) & (F.coalesce("number", F.lit("")) != "")).groupBy("kind", "number").agg(F.min("pos").alias("pos"))
    failed = F.col("result").isin("0건", "오류")
    seen = existing.groupBy("kind", "number").agg(F.max(failed.cast("int")).alias("_failed"), F.max((~failed).cast("int")).alias("_done"))
    joined = wanted.join(seen, ["kind", "number"], "left")
    fresh, again = F.col("_failed").isNull(), F.coalesce(F.col("_failed") == 1, F.lit(False)) & (F.coalesce("_done", F.lit(0)) == 0)
    keep = again if only_failed else (fresh | again) if retry_failed else fresh
    open_ = joined.where(keep).withColumn("_kind", F.array_position(kinds, F.col("kind")))
    if limit is not None:
        open_ = open_.orderBy("_kind", "pos").limit(limit)
    return open_.select("kind", "number", "pos")


def staged_record(items: DataFrame) -> DataFrame:
    """Register items as records: blank text is null, classes are the digit-only ones as numbers, dates are dates."""
    text = [c for c in items.columns if c not in ("classes", "date")]
    classes = F.transform(F.filter(F.split(F.coalesce("classes", F.lit("")), r"\|"), lambda x: F.trim(x).rlike("^[0-9]+$")), lambda x: F.trim(x).cast("int"))
    blank = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in text}
    return items.select(*[blank[c].alias(c) for c in text], classes.alias("classes"), F.try_to_date("date", "yyyyMMdd").alias("date"))
