"""Secret scan with corpus-wide ownership frequency (operator 1).

Only DataFrame functions. One scan finds the base spans (assignments, access keys, long hex
runs) and opaque tokens. Each candidate's hash is aggregated by distinct repositories and
owners over the whole corpus: a value seen under several owners, or in many repositories, is a
copied example; one that a single owner has in few repositories looks live. Base spans always
stay; opaque tokens are added where live and where no base span overlaps them.

Positions are code points, end exclusive, of the whole match: the pieces between matches give
the lengths to sum up.

Defined results. A null or empty text has no span; rows are kept as they come, repeated ones
too; a null owner or repository counts as a value of its own; an empty table gives no row;
other columns are left out, whatever their names. A text of any length is scanned whole:
spans are gathered in runs of RUN, so the work grows with the matches, not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import store

# The kinds in their order, and the pattern of each.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"

_SPAN = "struct<start:int,kind:int,end:int,value:bigint>"
#: Spans that are gathered one by one before they are put aside together.
RUN = 256


def _nothing() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _added(done: Column, now: Column, one: Column) -> tuple[Column, Column]:
    """(done, now) with one more span: now is put into done when it is full."""
    more = F.concat(now, F.array(one))
    full = F.size(more) >= RUN
    return F.when(full, F.concat(done, F.array(more))).otherwise(done), F.when(full, _nothing()).otherwise(more)


def _all(acc: Column) -> Column:
    return F.concat(F.flatten(acc["done"]), acc["now"])


def _found(text: Column, kind: int, pattern: str, keep, group: int = 0) -> Column:
    """The matches that keep() holds for, with positions; the value is hashed from the group."""
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("done"), _nothing().alias("now"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.xxhash64(x["part"]).alias("value"))
        done, now = _added(acc["done"], acc["now"], one)
        hit = x["hit"].isNotNull() & keep(x)
        return F.struct(end.alias("at"), F.when(hit, done).otherwise(acc["done"]).alias("done"), F.when(hit, now).otherwise(acc["now"]).alias("now"))

    return F.when(text.rlike(pattern), F.aggregate(zipped, zero, step, _all)).otherwise(_nothing())


def base_spans(text: Column) -> Column:
    """Array of struct(start, kind, end, value), by start, then kind."""
    return F.array_sort(
        F.concat(
            _found(text, 0, ASSIGN, lambda x: F.length(x["part"]) >= 6, 2),
            _found(text, 1, ACCESS, lambda x: F.length(x["part"]) >= 20),
            _found(text, 2, HEX, lambda x: F.lit(True)),
        )
    )


def opaque_spans(text: Column) -> Column:
    """Runs of 20 characters or more that mix capitals, small letters and digits."""
    return _found(text, 3, OPAQUE, lambda x: x["part"].rlike("[0-9]") & x["part"].rlike("[a-z]") & x["part"].rlike("[A-Z]"))


def apart(base: Column | str, opaque: Column | str) -> Column:
    """The opaque spans that no base span overlaps, by one walk over all spans in order.

    Opaque spans never overlap each other, so one waits until the next, or a base span in it.
    """
    none = F.lit(None).cast(_SPAN)
    zero = F.struct(F.lit(0).alias("covered"), none.alias("waits"), F.array().cast(f"array<array<{_SPAN}>>").alias("done"), _nothing().alias("now"))

    def flushed(acc: Column) -> tuple[Column, Column]:
        done, now = _added(acc["done"], acc["now"], acc["waits"])
        waits = acc["waits"].isNotNull()
        return F.when(waits, done).otherwise(acc["done"]), F.when(waits, now).otherwise(acc["now"])

    def step(acc: Column, s: Column) -> Column:
        opaque_one = s["kind"] == KINDS.index("opaque")
        done, now = flushed(acc)
        hit = acc["waits"].isNotNull() & (s["start"] < acc["waits"]["end"])
        waits = F.when(opaque_one, F.when(acc["covered"] <= s["start"], s).otherwise(none)).otherwise(F.when(hit, none).otherwise(acc["waits"]))
        covered = F.when(opaque_one, acc["covered"]).otherwise(F.greatest(acc["covered"], s["end"]))
        return F.struct(covered.alias("covered"), waits.alias("waits"), F.when(opaque_one, done).otherwise(acc["done"]).alias("done"), F.when(opaque_one, now).otherwise(acc["now"]).alias("now"))

    def last(acc: Column) -> Column:
        return F.concat(_all(acc), F.when(acc["waits"].isNotNull(), F.array(acc["waits"])).otherwise(_nothing()))

    walked = F.aggregate(F.array_sort(F.concat(base, opaque)), zero, step, last)
    return F.when(F.size(opaque) == 0, _nothing()).when(F.size(base) == 0, opaque if isinstance(opaque, Column) else F.col(opaque)).otherwise(walked)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "source", repository: str | None = None, max_owners: int = 1, max_repositories: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, base and spans (arrays), n_live, n_copied, n_owners, n_repositories.

    repository defaults to the owner. A candidate is live with at most max_owners owners and
    max_repositories repositories, else copied; n_owners and n_repositories are the most that
    any candidate of the row has.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    repo = F.col(repository or owner).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(owner).cast("string").alias("owner"), repo.alias("repo"), base_spans(text).alias("base"), opaque_spans(text).alias("opaque"))
    found = store.stored(rows.withColumn("opaque", apart("base", "opaque")).withColumn("row", F.monotonically_increasing_id()), "secrets")

    each = found.select("row", "owner", "repo", F.explode(F.concat("base", "opaque")).alias("s")).select("row", "owner", "repo", "s")
    by_repo = each.groupBy(F.col("s.value").alias("value"), "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"))
    owners = by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repositories"))
    judged = each.select("row", "s", F.col("s.value").alias("value")).join(owners, "value")
    judged = judged.withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))
    added = F.collect_list(F.when(F.col("live") & (F.col("s.kind") == KINDS.index("opaque")), F.col("s")))
    by_row = judged.groupBy("row").agg(F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"), F.max("n_owners").alias("n_owners"), F.max("n_repositories").alias("n_repositories"), added.alias("added"))
    out = found.join(by_row, "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", _nothing())))
    return out.select("doc_id", "text_hash", "base", spans.alias("spans"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_copied", "n_owners", "n_repositories")])


def spelled(spans: Column | str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column | str, name: str) -> Column:
    """The spans of one kind. (A second parameter of the lambda would be the place in the array.)"""
    return F.filter(spans, lambda s: s["kind"] == KINDS.index(name))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """docs with every span replaced by [SECRET]; only rows with spans are joined and rebuilt.

    found: of scan_secrets() on the same rows. size_col, where docs has it, follows the text.
    Rows of one id and text have the same spans, so one of them stands for all. The pieces of a
    text are gathered in runs, as its spans are.
    """
    hit_id, hit_hash, hit_spans, new = (store.free_name(docs, n) for n in ("__hit_id", "__hit_hash", "__hit_spans", "__hit_text"))
    one = found.where(F.size("spans") > 0).groupBy("doc_id", "text_hash").agg(F.max("spans").alias("spans"))
    hit = one.select(F.col("doc_id").alias(hit_id), F.col("text_hash").alias(hit_hash), F.col("spans").alias(hit_spans))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[SECRET]"))).otherwise(F.lit(""))
        more = F.concat(acc["now"], F.array(gap))
        full = F.size(more) >= RUN
        done = F.when(full, F.concat(acc["done"], F.array(F.array_join(more, "")))).otherwise(acc["done"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), done.alias("done"), F.when(full, F.array().cast("array<string>")).otherwise(more).alias("now"))

    strings = F.array().cast("array<string>")
    zero = F.struct(F.lit(0).alias("at"), strings.alias("done"), strings.alias("now"))
    rebuilt = F.aggregate(hit_spans, zero, step, lambda acc: F.concat(F.array_join(acc["done"], ""), F.array_join(acc["now"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    joined = docs.join(hit, F.col(id_col).eqNullSafe(F.col(hit_id)) & (F.xxhash64(text) == F.col(hit_hash)), "left")
    # the new text has a name of its own, as a select would take the sibling alias for the old text inside the lambda
    joined = joined.withColumn(new, F.when(F.col(hit_spans).isNotNull(), rebuilt))
    changed = F.col(new).isNotNull()
    cols = {text_col: F.when(changed, F.col(new)).otherwise(F.col(text_col))}
    if size_col in docs.columns:
        cols[size_col] = F.when(changed, F.length(new).cast(docs.schema[size_col].dataType)).otherwise(F.col(size_col))
    return joined.withColumns(cols).select(*docs.columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("__repository", F.concat_ws("/", "source", "lang"))
    found = scan_secrets(docs, repository="__repository")
    kinds = [F.size(of_kind("base", name)).cast("long").alias(f"n_{name}") for name in KINDS[:3]]
    return found.select("doc_id", *kinds, F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"), "n_live", "n_copied", "n_owners", "n_repositories")
