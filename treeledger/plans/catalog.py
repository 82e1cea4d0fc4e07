"""The registered queries: name -> (spark, folder of the tables) -> DataFrame."""

from pyspark.sql import functions as F

from ..functions import (
    base_name,
    change_label,
    change_mask,
    digest,
    format_bytes,
    format_duration,
    format_grouped,
    format_time,
    is_ignored,
    join_path,
    leading_slashes,
    path_depth,
    relative_to,
    trim_trailing_slashes,
    within_depth,
)
from ..jobs import hash_due_chunks
from ..operators import (
    action_counts,
    any_change,
    apply_plan,
    change_report,
    changes_between,
    compare,
    compare_directories,
    counts_with_matches,
    differences,
    digest_tree,
    history,
    latest_changes,
    leaf_bits,
    merge_changes,
    merged_roots,
    mismatched,
    only_in,
    plan_refresh,
    reconcile,
    reconcile_by_sketch,
    reconcile_multiset,
    report,
    self_check,
    status_counts,
    text_chunks,
    tree_digest,
    tree_summary,
    unexpected_roots,
    verdict,
    violations,
)
from ..sources import hash_files, scan_tree
from ..sources.content import task_count
from ..sources.scratch import fresh_folder, materialise
from . import derive
from .derive import table

IGNORE = ["^src1/"]
INCLUDE = ["/en/"]
SHALLOW, DEEP = 2, 3
CHUNK = 1024  # bytes; small so that documents have several chunks
MAX_TEXT_CHUNKS = 2**31 // CHUNK  # a Spark string is at most 2 GiB


def _documents(spark, folder):
    return table(spark, folder, "documents")


def _copies(spark, folder):
    documents = _documents(spark, folder)
    return derive.copy_a(documents), derive.copy_b(documents)


# Comparing


def compare_missing_left(spark, folder):
    a, b = _copies(spark, folder)
    return only_in(b, a).orderBy("relative_path")


def compare_missing_right(spark, folder):
    a, b = _copies(spark, folder)
    return only_in(a, b).orderBy("relative_path")


def compare_mismatch(spark, folder):
    a, b = _copies(spark, folder)
    return mismatched(a, b).orderBy("relative_path")


def compare_status(spark, folder):
    return compare(*_copies(spark, folder))


def compare_report(spark, folder):
    return report(compare(*_copies(spark, folder)))


def compare_status_counts(spark, folder):
    return status_counts(compare(*_copies(spark, folder)))


def compare_verdict(spark, folder):
    return verdict(compare(*_copies(spark, folder)))


def compare_verdict_self(spark, folder):
    a, _ = _copies(spark, folder)
    return verdict(compare(a, a))


def compare_multi_root(spark, folder):
    """Several roots in one manifest: the key is the root and the path below it."""
    a, b = (derive.per_root(m) for m in _copies(spark, folder))
    return mismatched(a, b, key_cols=("prefix", "relative_path")).orderBy("prefix", "relative_path")


def _with_trees(*manifests):
    """Manifests and their digest trees as a store keeps them (written, in order of the path's hash), and the level
    at which to compare their leaves."""
    found, bits = [], []
    for manifest in manifests:
        rows = manifest.select("relative_path", "sha512", F.xxhash64("relative_path").alias("path_hash"))
        rows = rows.repartitionByRange("path_hash").sortWithinPartitions("path_hash")
        rows = materialise(rows, fresh_folder(rows.sparkSession))
        bits.append(leaf_bits(rows.count()))
        found.append((rows, materialise(digest_tree(rows, bits[-1]), fresh_folder(rows.sparkSession))))
    (left, left_tree), (right, right_tree) = found
    return left, right, left_tree, right_tree, min(bits)


def _nearly_equal(spark, folder):
    documents = _documents(spark, folder)
    return _with_trees(derive.copy_c(documents), derive.copy_d(documents))


def compare_by_tree_digest(spark, folder):
    """Nearly equal copies: only rows of unlike leaves are read."""
    return differences(*_nearly_equal(spark, folder), hash_col="path_hash")


def compare_counts_by_tree_digest(spark, folder):
    sides = _nearly_equal(spark, folder)
    return counts_with_matches(differences(*sides, hash_col="path_hash"), sides[2])


def compare_by_tree_digest_drifted(spark, folder):
    """Copies A and B, which differ everywhere and hold unfinished rows: the same as their comparison."""
    return differences(*_with_trees(*_copies(spark, folder)), hash_col="path_hash")


def compare_by_directory(spark, folder):
    return compare_directories(*_copies(spark, folder))


# Digests


def digest_documents(spark, folder):
    return _documents(spark, folder).select("doc_id", F.hex(digest("text", 256)).alias("sha256"))


def digest_pages_sha512(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.hex(digest("html")).alias("sha512"))


def digest_copies(spark, folder):
    """Equal content found by its SHA-512: the smallest id and the number of copies of each."""
    hashed = _documents(spark, folder).select("doc_id", digest("text").alias("sha512"))
    copies = hashed.groupBy("sha512").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return copies.drop("sha512")


def chunk_digests(spark, folder):
    chunks = text_chunks(_documents(spark, folder), ["doc_id"], F.col("text"), CHUNK, bits=256)
    return chunks.select("doc_id", "chunk_no", F.hex("digest").alias("chunk_sha256"), "chunks")


def chunk_tree_digest(spark, folder):
    chunks = text_chunks(_documents(spark, folder), ["doc_id"], F.col("text"), CHUNK, bits=256)
    roots = tree_digest(chunks, ["doc_id"], MAX_TEXT_CHUNKS, bits=256)
    return roots.select("doc_id", F.hex("tree_digest").alias("tree_sha256"))


# Patterns, depth and paths


def filter_ignore(spark, folder):
    a, _ = _copies(spark, folder)
    return a.where(~is_ignored("relative_path", IGNORE)).select("relative_path")


def filter_include_over_ignore(spark, folder):
    a, _ = _copies(spark, folder)
    return a.where(~is_ignored("relative_path", IGNORE, INCLUDE)).select("relative_path")


def filter_maxdepth(spark, folder):
    pages = table(spark, folder, "pages").select(derive.url_path().alias("relative_path"))
    return pages.where(within_depth("relative_path", 1)).select(
        "relative_path", path_depth("relative_path").cast("bigint").alias("depth")
    )


def path_normalise(spark, folder):
    root = F.regexp_extract("url", "^https?://[^/]+", 0)
    slashes = F.repeat(F.lit("/"), (F.col("page_id") % 4).cast("int"))
    return table(spark, folder, "pages").select(
        "page_id",
        trim_trailing_slashes("url").alias("trimmed"),
        trim_trailing_slashes(slashes).alias("only_slashes"),
        leading_slashes(F.concat(slashes, "url")).cast("bigint").alias("slashes"),
        relative_to("url", root).alias("relative"),
        base_name("url").alias("base"),
        join_path(root, derive.url_path()).alias("joined"),
    )


# Totals


def tree_totals(spark, folder):
    return tree_summary(derive.document_tree(_documents(spark, folder)))


def tree_totals_by_source(spark, folder):
    return tree_summary(derive.document_tree(_documents(spark, folder)), by=("top",))


def tree_totals_maxdepth(spark, folder):
    pages = table(spark, folder, "pages").select(
        derive.url_path().alias("relative_path"),
        F.lit("file").alias("kind"),
        F.octet_length("html").cast("bigint").alias("size"),
    )
    return tree_summary(pages, maxdepth=1)


# Refresh


def _plan(spark, folder, maxdepth, clean_ignored):
    saved, now = _copies(spark, folder)
    return plan_refresh(
        derive.as_listing(now),
        saved,
        ignore=IGNORE,
        include=INCLUDE,
        maxdepth=maxdepth,
        clean_ignored=clean_ignored,
    )


def _shown(plan):
    return plan.select(
        "relative_path", "action", F.col("change_mask").cast("bigint").alias("change_mask"), "change_label"
    )


def metadata_change_mask(spark, folder):
    saved, now = _copies(spark, folder)
    names = ("size", "mtime_ns", "ctime_ns")
    was = saved.select("relative_path", *[F.col(c).alias("was_" + c) for c in names])
    both = was.join(now.select("relative_path", *[F.col(c).alias("now_" + c) for c in names]), "relative_path")
    mask = change_mask()
    return both.select("relative_path", mask.cast("bigint").alias("change_mask"), change_label(mask).alias("change_label"))


def refresh_plan(spark, folder):
    return _shown(_plan(spark, folder, DEEP, clean_ignored=False))


def refresh_plan_clean_ignored(spark, folder):
    return _shown(_plan(spark, folder, SHALLOW, clean_ignored=True))


def refresh_plan_multi_root(spark, folder):
    """Several roots in one manifest: the decision is made per root and path below it."""
    saved, now = (derive.per_root(m) for m in _copies(spark, folder))
    keys = ("prefix", "relative_path")
    plan = plan_refresh(derive.as_listing(now, "prefix"), saved, ignore=["^en/"], key_cols=keys)
    return plan.select(*keys, "action", F.col("change_mask").cast("bigint").alias("change_mask"))


def refresh_action_counts(spark, folder):
    counts = action_counts(_plan(spark, folder, SHALLOW, clean_ignored=True))
    return counts.withColumn("change_mask", F.col("change_mask").cast("bigint"))


def refresh_report(spark, folder):
    return change_report(_plan(spark, folder, DEEP, clean_ignored=False))


def refresh_apply(spark, folder):
    """The next manifest, with the digests of B's content where hashing is due."""
    _, now = _copies(spark, folder)
    plan = _plan(spark, folder, DEEP, clean_ignored=False)
    hashed = now.select("relative_path", "size", "mtime_ns", "ctime_ns", "sha512")
    new = apply_plan(plan, hashed)
    return new.select(
        "relative_path",
        "size",
        "mtime_ns",
        "ctime_ns",
        F.col("sha512").isNotNull().alias("has_digest"),
        "bytes_hashed",
    )


def refresh_any_change(spark, folder):
    return any_change(_plan(spark, folder, DEEP, clean_ignored=False))


def _roots(spark, folder):
    pages = table(spark, folder, "pages")
    root = F.regexp_extract("url", "^https?://[^/]+", 0)
    saved = pages.select(root.alias("prefix")).distinct()
    given = pages.where(F.col("url").startswith("https:")).select(F.concat(root, F.lit("/")).alias("prefix"))
    return saved, given


def root_guard(spark, folder):
    return unexpected_roots(*_roots(spark, folder))


def root_merge(spark, folder):
    return merged_roots(*_roots(spark, folder), replace=True)


# Readable values


def format_values(spark, folder):
    orders = table(spark, folder, "orders")
    key = F.col("o_orderkey").cast("decimal(19,0)")  # the products outgrow a BIGINT
    return orders.select(
        "o_orderkey",
        format_bytes(key * key * 1000).alias("bytes"),
        format_duration(key * key * 1_000_003).alias("duration"),
        format_time(F.lit(derive.EPOCH_NS) - key * 1_000_000_007).alias("time"),
        format_grouped(F.col("o_totalprice").cast("decimal(18,2)") * 1000).alias("grouped"),
    )


# Tables instead of trees


def reconcile_orders(spark, folder):
    orders = table(spark, folder, "orders")
    return reconcile(
        orders, derive.drifted_orders(orders), ["o_orderkey"], ["o_orderstatus", "o_totalprice", "o_orderdate"]
    )


def reconcile_lineitem(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    keys, values = ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_tax"]
    return reconcile_multiset(lineitem, derive.drifted_lineitem(lineitem), keys, values)


def reconcile_documents(spark, folder):
    documents = table(spark, folder, "documents")
    return reconcile(documents, derive.drifted_documents(documents), ["doc_id"], ["text", "lang"])


def reconcile_events(spark, folder):
    """Instants beside free text and once more inside a nested value."""
    events = table(spark, folder, "events").withColumn("marks", F.array(F.struct("ts", "user_id")))
    values = ["ts", "event_type", "props", "marks"]
    return reconcile(events, derive.drifted_events(events), ["event_id"], values)


def reconcile_lineitem_by_sketch(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    keys, values = ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_tax"]
    return reconcile_by_sketch(lineitem, derive.drifted_lineitem(lineitem), keys, values)


def reconcile_events_by_sketch(spark, folder):
    """Nested values and instants, all rows of one side repeated."""
    events = table(spark, folder, "events").withColumn("marks", F.array(F.struct("ts", "user_id")))
    values = ["ts", "event_type", "props", "marks"]
    few = F.col("event_id") % 211 == 3
    drifted = derive.drifted_events(events.where(few)).unionByName(events.where(~few).select("event_id", *values))
    twice = [side.withColumn("_", F.explode(F.array(F.lit(1), F.lit(2)))) for side in (events, drifted)]
    return reconcile_by_sketch(*twice, ["event_id"], values)


# Manifest quality and history


def _faulty(spark, folder):
    """Copies A and B in one table, so paths repeat; some digests damaged."""
    a, b = _copies(spark, folder)
    size = F.col("size")
    damaged = (
        F.when(size % 13 == 0, F.substring("sha512", 1, 63))
        .when(size % 17 == 0, F.unhex(F.lit("00" * 64)))
        .otherwise(F.col("sha512"))
    )
    hashed = F.when(size % 19 == 0, size + 1).otherwise(F.col("bytes_hashed"))
    return a.union(b).select("relative_path", "size", damaged.alias("sha512"), hashed.alias("bytes_hashed"))


def manifest_self_check(spark, folder):
    return self_check(_faulty(spark, folder))


def manifest_self_check_clean(spark, folder):
    a, _ = _copies(spark, folder)
    return self_check(a)


def manifest_violations(spark, folder):
    return violations(_faulty(spark, folder))


def snapshot_history(spark, folder):
    a, b = _copies(spark, folder)
    c = derive.copy_c(_documents(spark, folder))
    columns = ["snapshot_id", "relative_path", "sha512"]
    one, two, three = (
        m.withColumn("snapshot_id", F.lit(i).cast("bigint")).select(*columns) for i, m in enumerate((a, b, c), 1)
    )
    return history(one.union(two).union(three), [1, 2, 3])


def snapshot_merge_on_read(spark, folder):
    """A as the base, the changes to B and on to C beside it: what is read is C."""
    a, b = _copies(spark, folder)
    c = derive.copy_c(_documents(spark, folder))
    values = ["size", "mtime_ns", "ctime_ns", "sha512", "bytes_hashed"]
    steps = [
        changes_between(old, new, values).withColumn("sequence", F.lit(i)) for i, (old, new) in enumerate([(a, b), (b, c)])
    ]
    merged = merge_changes(a, latest_changes(steps[0].unionByName(steps[1]), values), values)
    return merged.withColumn("sha512", F.col("sha512").isNotNull()).withColumnRenamed("sha512", "has_digest")


# The given tables as files


def tree_listing(spark, folder):
    return scan_tree(spark, folder).select("relative_path", "kind", "size", "depth")


def _table_files(spark, folder):
    files = scan_tree(spark, folder).where(F.col("kind") == "file")
    return files.select("relative_path", "size", "mtime_ns", "ctime_ns")


def tree_sha512(spark, folder):
    files = _table_files(spark, folder)
    total = files.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).first()
    hashed = hash_files(files, folder, task_count(total.n, total.b or 0, spark.sparkContext.defaultParallelism))
    return hashed.select("relative_path", "size", F.hex("sha512").alias("sha512"), "error")


def tree_chunk_sha512(spark, folder):
    digests, _ = hash_due_chunks(_table_files(spark, folder), folder, fresh_folder(spark), chunk_bytes=1 << 20)
    return digests.select("relative_path", "size", F.hex("tree_sha512").alias("tree_sha512"))


QUERIES = [
    compare_missing_left,
    compare_missing_right,
    compare_mismatch,
    compare_status,
    compare_report,
    compare_status_counts,
    compare_verdict,
    compare_verdict_self,
    compare_multi_root,
    compare_by_tree_digest,
    compare_counts_by_tree_digest,
    compare_by_tree_digest_drifted,
    compare_by_directory,
    digest_documents,
    digest_pages_sha512,
    digest_copies,
    chunk_digests,
    chunk_tree_digest,
    filter_ignore,
    filter_include_over_ignore,
    filter_maxdepth,
    path_normalise,
    tree_totals,
    tree_totals_by_source,
    tree_totals_maxdepth,
    metadata_change_mask,
    refresh_plan,
    refresh_plan_clean_ignored,
    refresh_plan_multi_root,
    refresh_action_counts,
    refresh_report,
    refresh_apply,
    refresh_any_change,
    root_guard,
    root_merge,
    format_values,
    reconcile_orders,
    reconcile_lineitem,
    reconcile_documents,
    reconcile_events,
    reconcile_lineitem_by_sketch,
    reconcile_events_by_sketch,
    manifest_self_check,
    manifest_self_check_clean,
    manifest_violations,
    snapshot_history,
    snapshot_merge_on_read,
    tree_listing,
    tree_sha512,
    tree_chunk_sha512,
]


def queries() -> dict:
    return {query.__name__: query for query in QUERIES}
