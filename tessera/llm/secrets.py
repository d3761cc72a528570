"""Secret scanning with corpus-wide ownership frequency, in DataFrame functions alone.

Candidates are found in each text with their places. The hashes of their values are aggregated by
the distinct repositories and owners that hold them: widely copied values are examples, those that
look random and belong to one owner are live-looking credentials. The rule, by value:

- example: EXAMPLE_OWNERS owners hold it, or EXAMPLE_REPOSITORIES repositories, be it of one owner;
- live: else, one owner holds it, it has a digit and a letter, LIVE_CHARACTERS different characters
  and LIVE_BITS bits of entropy a character;
- neither: else.

Places come from splitting at the pattern: the lengths of the parts between matches, and of the
matches, add up to where each match starts. Lengths are in code points. Matches are rows, so the sum
is a window over a text's matches and takes time in proportion, however many one text has.

Edge cases: a null text counts as empty and has no spans (the digest of no spans is that of the
empty string); a null owner counts as one owner, a null repository as one repository; repeated rows
each get their own row; spans that start alike are ordered by kind; a very long text with very many
matches is read in linear time; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import materialize

# The kinds in order, each with its pattern and the least length of what must be that long.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: From so many owners or repositories on a value is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10
#: A live value has so many different characters and bits of entropy a character at least.
LIVE_CHARACTERS, LIVE_BITS = 8, 2.8
CANDIDATE = "array<struct<start:int,rank:int,kind:string,end:int,verdict:string>>"


def looks_random(value: Column) -> Column:
    """A digit, a letter, and different characters and entropy enough."""
    size, each = F.length(value), F.array_distinct(F.split(value, ""))
    share = lambda c: (size - F.length(F.replace(value, c, F.lit("")))) / size
    bits = F.aggregate(each, F.lit(0.0), lambda sum_, c: sum_ - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(each) >= LIVE_CHARACTERS) & (bits >= LIVE_BITS)


def matches(rows: DataFrame, kind: str, rank: int, pattern: str) -> DataFrame:
    """row, owner, repository, i, part and match lengths, value: pattern's leftmost non-overlapping matches, a row for each."""
    text = F.col("text")
    both = rows.select("row", "owner", "repository", F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    each = both.select("row", "owner", "repository", F.posexplode(F.arrays_zip(F.transform("parts", F.length).alias("part"), F.col("found"))).alias("i", "m"))
    each = each.where(F.col("m.found").isNotNull())  # the last part has no match behind it
    match = F.col("m.found")
    value = F.regexp_extract(match, ASSIGN, 2) if kind == "assign" else match
    told = each.select("row", "owner", "repository", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), "i", F.col("m.part").alias("part"), F.length(match).alias("size"), value.alias("value"))
    return told.select("*", (F.length("value") >= LEAST[kind]).alias("counts"), F.sha2("value", 256).alias("hash"), looks_random(F.col("value")).alias("random")).drop("value")


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner: str = "source", repository: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows (row, doc_id) and their candidates (row, owner, repository, rank, kind, start, end, hash, random), both written once."""
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(owner).cast("string").alias("owner"),
        F.col(repository or id_column).cast("string").alias("repository"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    # A pattern that cannot match for want of its letters is not run.
    words, key = F.col("text").rlike("(?i)password|passwd|secret|token|api_?key"), F.col("text").contains("AKIA")
    likely = {"assign": words & F.col("text").rlike(ASSIGN), "access": key & F.col("text").rlike(ACCESS), "hex": F.col("text").rlike(HEX)}
    # One pass over the texts; those in which a pattern matches are kept beside the narrow rows.
    any_ = likely["assign"] | likely["access"] | likely["hex"]
    scanned = materialize(rows.select("row", "doc_id", "owner", "repository", F.when(any_, F.col("text")).alias("text")), "scanned")
    texts = scanned.where(F.col("text").isNotNull())
    every = [matches(texts.where(likely[k]), k, n, p) for n, (k, p) in enumerate(patterns.items())]
    found = every[0].unionByName(every[1]).unionByName(every[2])
    before = Window.partitionBy("row", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("part") + F.col("size")).over(before).cast("int")
    placed = found.withColumn("end", end).where("counts").withColumn("start", F.col("end") - F.col("size"))
    return scanned.select("row", "doc_id"), materialize(placed.select("row", "owner", "repository", "rank", "kind", "start", "end", "hash", "random"), "candidates")


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners and repositories of each candidate value.

    Counted from distinct triples upward, so that a value in every repository is spread by its
    repositories first and reaches one task as one number for each owner.
    """
    triples = found.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = triples.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner: str = "source", repository: str | None = None, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """doc_id and base: the candidates by start and kind, each with what its ownership says (live, example or '')."""
    rows, found = candidates(docs, id_column, text_column, owner, repository)
    # Written, so that both sides of the join are plain exchanges and a value in very many texts can be split.
    held = found.join(materialize(ownership(found), "ownership"), "hash")
    copied = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    verdict = F.when(copied, F.lit("example")).when((F.col("owners") == 1) & F.col("random"), F.lit("live")).otherwise(F.lit(""))
    own = F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", verdict.alias("verdict"))))  # a text's own candidates
    marked = held.groupBy("row").agg(own.alias("base"))
    return rows.join(marked, "row", "left").select("doc_id", F.coalesce("base", F.lit([]).cast(CANDIDATE)).alias("base"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))))


def all_spans() -> Column:
    """Base spans and those of the verdicts, by start and kind: assign, access, hex, live, example.

    No two kinds of base spans are equal (an assignment has letters that no hex number has, an access key
    begins with upper case), so each verdict's span stands once.
    """
    fields = lambda c, rank, kind: F.struct(c["start"].alias("start"), rank.cast("int").alias("rank"), kind.alias("kind"), c["end"].alias("end"))
    base = F.transform("base", lambda c: fields(c, c["rank"], c["kind"]))
    told = F.transform(F.filter("base", lambda c: c["verdict"] != ""), lambda c: fields(c, F.when(c["verdict"] == "live", 3).otherwise(4), c["verdict"]))
    return F.array_sort(F.concat(base, told))
