"""Line deduplication by a log-template tree, in DataFrame expressions only.

A line is cut at white space, and tokens with a digit become <*>. The tree has a fixed depth: a line goes by its number
of tokens and then by its first three to a leaf. In a leaf, a place keeps a token that more than half of the leaf's
different lines have there and is variable otherwise; lines that agree with at least six tenths of the places after the
leading ones, and with three of them or more, share the leaf's template. (The leading tokens are equal in a leaf anyway
and tell nothing.) The other lines go on to further groups of the leaf: each takes the token and place that most of them
share, but not all, and those that take the same are looked at in the same way, until every line has joined a template
or is alone; then it is its own template. Tokens with a digit stay where fewer than half of a line's tokens
have none, as nothing but numbers would be left out of such a line. A template that occurs in several documents is recurring: its lines
are dropped from all documents but the first (least doc_id), so that the text is not lost altogether. Lines of fewer than
four tokens have no variable places: they recur as they are, in eight documents or more, as few words often meet by chance.
Blank lines stay.

The text is masked once, and only hashes of lines are kept and shuffled to find leaves and templates. Tokens are looked
at in leaves with different lines in different documents only, of one line for each hash. Common lines are counted before
they are shuffled.

Null text stays null and has no lines; an empty text stays empty. A document without dropped lines is returned as it was.
Rows that repeat a doc_id are one document, so their equal lines don't recur; each row loses its own lines, as rows go by
doc_id and a hash of their text. Rows with a null doc_id stay as they are. Other columns pass through, and columns named
like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.llm.common import cut, free, let

LEADING, MIN_TOKENS, AGREE = 3, 4, 0.6
#: Places after the leading ones that a template of different lines has to fix at least.
MIN_FIXED = 3
#: Documents that a line of fewer than MIN_TOKENS tokens has to occur in to be recurring.
SHORT_DOCS = 8


def masked(line: Column) -> Column:
    """Tokens between single blanks, with <*> for those that have a digit if they are half of the tokens of a long line at most."""
    plain = F.trim(F.regexp_replace(line, r"\s+", " "))
    variable = r"(?<!\S)[^\s0-9]*[0-9]\S*"
    few = 2 * F.regexp_count(plain, F.lit(variable)) <= n_tokens(plain)
    return F.when(plain.rlike("[0-9]") & (n_tokens(plain) >= MIN_TOKENS) & few, F.regexp_replace(plain, variable, "<*>")).otherwise(plain)


def n_tokens(line: Column) -> Column:
    """Tokens between single blanks."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (hash of the text), line number, leaf and line hashes, of the lines that aren't blank. A short line is a leaf
    of its own, and both its hashes are the same. Whether masking can change any line is told from the whole text."""
    changes = F.col(text).rlike(r"[0-9]|[^\S \n]|  |\n | \n|^ | $")
    # in a projection of its own: beside the generator it would be computed again for each line
    told = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), changes.alias("changes"), F.col(text).alias("text"))
    each = told.select("doc_id", "row", "changes", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    each = each.select("doc_id", "row", "line_no", F.when(F.col("changes"), masked(F.col("line"))).otherwise(F.col("line")).alias("masked"))
    each = each.withColumn("n_tokens", n_tokens(F.col("masked"))).where("masked <> ''").withColumn("key", F.xxhash64("masked"))
    leaf = F.when(F.col("n_tokens") < MIN_TOKENS, F.col("key")).otherwise(F.xxhash64("n_tokens", F.substring_index("masked", " ", LEADING)))
    return each.select("doc_id", "row", "line_no", leaf.alias("leaf"), "key")


def shared_templates(docs: DataFrame, lines: DataFrame, seen: DataFrame, doc_id: str, text: str) -> DataFrame:
    """leaf, key and template (own) of the lines that share one, in leaves that hold different lines of different
    documents. seen: for each leaf and key the least and the greatest doc_id. A round for each level of groups; groups get
    smaller with every level."""
    mixed = seen.groupBy("leaf").agg(F.count("*").alias("lines"), F.min("low").alias("low"), F.max("high").alias("high")).where("lines > 1 and low <> high").select("leaf", "lines")
    known = seen.join(mixed, "leaf").select("leaf", "key", F.col("low").alias("doc_id"))
    places = lines.join(known, ["leaf", "key", "doc_id"]).groupBy("leaf", "key", "doc_id").agg(F.min(F.struct("row", "line_no")).alias("at"))
    wanted = places.groupBy("doc_id", "at.row").agg(F.collect_list(F.struct("leaf", "key", "at.line_no")).alias("wanted"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    found = texts.join(wanted, ["doc_id", "row"]).withColumn("parts", F.split("text", "\n"))
    told = found.select("doc_id", "row", F.inline(F.transform("wanted", lambda w: F.struct(w["leaf"].alias("leaf"), w["key"].alias("key"), masked(F.get("parts", w["line_no"])).alias("masked")))))
    # equal rows are in one partition already
    told = cut(told.dropDuplicates(["doc_id", "row", "leaf", "key"]).select("leaf", "key", "masked"))
    group, shared = told.select("leaf", "key", F.col("leaf").alias("group")), None
    while True:
        judged = cut(_judged(told, group))
        joined = judged.where("shares").select("leaf", "key", F.col("group").alias("own"))
        shared = joined if shared is None else shared.unionByName(joined)
        group = cut(_regrouped(told, judged.where("not shares").select("leaf", "key", "group")))
        if group.isEmpty():
            return shared


def _tokens(told: DataFrame, group: DataFrame) -> DataFrame:
    """group, leaf, key and hash of place and token, for the places after the leading ones."""
    each = told.join(group, ["leaf", "key"]).select("group", "leaf", "key", F.posexplode(F.split("masked", " ")).alias("place", "token"))
    return each.where(F.col("place") >= LEADING).select("group", "leaf", "key", F.xxhash64("place", "token").alias("token"))


def _judged(told: DataFrame, group: DataFrame) -> DataFrame:
    """leaf, key and group of lines, and whether they share the template of their group."""
    tokens, sizes = _tokens(told, group), group.groupBy("group").agg(F.count("*").alias("lines"))
    most = tokens.groupBy("group", "token").agg(F.count("*").alias("n")).where("n > 1")  # groups have two lines or more
    fixed = most.join(sizes, "group").where("n * 2 > lines").select("group", "token", F.lit(1).alias("agrees"))
    agree = tokens.join(fixed, ["group", "token"], "left").groupBy("group", "leaf", "key").agg(F.count("agrees").alias("agrees"), F.count("*").alias("n_tokens"))
    return agree.select("leaf", "key", "group", (F.col("agrees") >= F.greatest(F.lit(MIN_FIXED), AGREE * F.col("n_tokens"))).alias("shares"))


def _regrouped(told: DataFrame, group: DataFrame) -> DataFrame:
    """leaf, key and new group of lines, where two or more take the same token: of those that several lines of the group
    have, but not all, the most frequent one. So every new group is smaller."""
    tokens, sizes = _tokens(told, group), group.groupBy("group").agg(F.count("*").alias("lines"))
    parting = tokens.groupBy("group", "token").agg(F.count("*").alias("n")).where("n > 1").join(sizes, "group").where("n < lines")
    taken = tokens.join(parting, ["group", "token"]).groupBy("group", "leaf", "key").agg(F.max(F.struct("n", "token")).alias("best"))
    taken = taken.select("leaf", "key", F.xxhash64("group", "best.token").alias("group"))
    return taken.join(taken.groupBy("group").agg(F.count("*").alias("lines")).where("lines > 1").select("group"), "group").select("leaf", "key", "group")


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row and line_no of the lines that go; equal rows give equal ones."""
    lines = cut(lines_of(docs, doc_id, text))
    seen = cut(lines.groupBy("leaf", "key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
    shared = shared_templates(docs, lines, seen, doc_id, text)
    named = seen.join(shared, ["leaf", "key"], "left").withColumn("own", F.coalesce("own", "key"))
    recurring = named.groupBy("leaf", "own").agg(F.min("low").alias("stays"), F.max("high").alias("last")).where("stays <> last")
    going = named.where("leaf <> key").join(recurring, ["leaf", "own"]).select("leaf", "key", "stays")
    short = lines.where("leaf = key").select("key", "doc_id").distinct().groupBy("key").agg(F.min("doc_id").alias("stays"), F.count("*").alias("docs"))
    going = going.unionByName(short.where(F.col("docs") >= SHORT_DOCS).select(F.col("key").alias("leaf"), "key", "stays"))
    return lines.join(going, ["leaf", "key"]).where("doc_id <> stays").select("doc_id", "row", "line_no")


def drop_recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the lines gone from `text`, the number of lines before, and the number that went."""
    _id, _row, _going, _left = free(docs, "_id", "_row", "_going", "_left")
    going = dropped_lines(docs, doc_id, text).groupBy(F.col("doc_id").alias(_id), F.col("row").alias(_row)).agg(F.sort_array(F.collect_set("line_no")).alias(_going))
    keyed = docs.withColumns({_id: F.col(doc_id).cast("long"), _row: F.xxhash64(text)})
    joined = keyed.where(F.col(_id).isNotNull()).join(going, [_id, _row], "left").select(*docs.columns, _going)
    joined = joined.unionByName(docs.where(F.col(doc_id).isNull()).withColumn(_going, F.lit(None).cast("array<int>")))
    parts = F.split(text, "\n")
    rest = F.when(F.col(_going).isNotNull(), let(parts, lambda p: let(F.array_append(_going, F.size(p)), lambda ends: _between(p, ends)))).otherwise(F.col(text))
    result = joined.withColumns({"n_lines": F.coalesce(F.size(parts), F.lit(0)).cast("long"), "n_dropped": F.coalesce(F.size(_going), F.lit(0)).cast("long"), _left: rest})
    return result.withColumn(text, F.col(_left)).drop(_going, _left)


def _between(parts: Column, ends: Column) -> Column:
    """The lines that lie between those numbered by ends (ascending); each line is looked at once."""
    before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(-1))
    return F.array_join(F.flatten(F.transform(ends, lambda end, i: F.slice(parts, before(i) + 2, end - before(i) - 1))), "\n")
