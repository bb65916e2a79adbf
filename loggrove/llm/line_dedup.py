"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A line is what ends at a line feed or at one of . ! ? , ; : | with white space
behind it, so that a passage inside a paragraph has lines too. A hash rolls over
each two neighbouring line hashes. Two bits of it say whether a chunk begins at
the first line of the two, two others whether one may end at the second (each
in three cases of four); a chunk goes from where it begins to the first end,
``LONGEST`` lines at most. So a chunk has two lines or more and depends on its
own lines alone: wherever a passage stands, it has the same chunks.

Of a chunk that several documents have, the document with the smallest id keeps
its copy. There the chunk's text is read, with the lines up to the chunks beside
it. The others compare it with their own byte by byte (white space around lines
does not count), and go on line by line in both directions, so that a passage
goes from its first to its last whole line. Within a document a chunk that has
occurred before, byte by byte, goes too, with the lines beside it in the same way. What is cut are runs of such lines that
have at least ``least_chars`` characters. A passage escapes if no chunk lies
inside it (one of eight lines in 1 of 200 cases, of ten in 1 of 2000).

Hashes alone cross the cluster to find repeated chunks; of the texts only chunks
that a document keeps for others move, once for each of them, and then each
text by document. A chunk that many documents have is pre-aggregated or split by
Spark, never gathered in one task.

Nulls: a null text stays null; a row with a null id stays as it is and is not
compared. Rows that repeat an id count as one document: none of them loses what
another of them has. Empty texts stay. A text may become empty. Of a very long
text each chunk is looked up among its own repeated chunks. An empty table gives
no rows. Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loggrove.llm.common import written

#: A line with its end. All repetitions are possessive: Java takes them in a loop,
#: without going back, whatever the length of a line.
LINE = r"(?!\z)[^\n.!?,;:|]*+(?:[.!?,;:|](?!\s)[^\n.!?,;:|]*+)*+(?:\n|[.!?,;:|]\s|\z)"
#: White space other than blanks, by far the most frequent, and line feeds.
OTHER_SPACES = ("\t", "\r", "\x0b", "\x0c")
AROUND = " \t\r\n"
#: Bits of the rolling hash of which one at least says that a chunk begins or may end.
BEGIN_BITS, END_BITS = 3, 12
#: Lines of a chunk.
LONGEST = 5


def with_lines(texts: DataFrame, column: str = "text") -> DataFrame:
    """Adds the lines of the text in ``column``, and whether it has white space
    other than blanks and line feeds (``odd``).

    One pass of a pattern that matches whole lines takes less time than marks
    behind line ends and a split at them, or than a split at a pattern."""
    text, first, *others = F.col(column), *OTHER_SPACES
    odd = F.contains(text, F.lit(first))
    for space in others:
        odd = odd | F.contains(text, F.lit(space))
    step = texts.withColumn("odd", odd)
    # odd is named here too, so that Spark does not move it into a lambda over the lines
    return step.withColumn("lines", F.when(F.col("odd").isNotNull(), F.regexp_extract_all(text, F.lit(LINE), F.lit(0))))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(AROUND))


def _bare_line(line: Column) -> Column:
    """``_bare`` of one of the lines. Blanks alone are trimmed much faster, and
    a line feed stands at the end of a line only."""
    return F.when(F.col("odd") | F.endswith(line, F.lit("\n")), _bare(line)).otherwise(F.trim(line))


def with_chunks(texts: DataFrame, line_hashes: Column) -> DataFrame:
    """Adds the arrays starts (the numbers of the lines at which chunks begin), ends
    and hashes of the chunks.

    No array that is computed here is used once only, inside a lambda: Spark
    would move its expression there and compute it for each element."""
    step = texts.withColumn("line_hashes", line_hashes)
    n = F.size("line_hashes")
    step = step.withColumn("rolling", F.zip_with("line_hashes", F.slice("line_hashes", 2, F.greatest(n, F.lit(1))), lambda x, y: F.xxhash64(x, y)))
    begins = lambda i: (i == 0) | (F.get("rolling", i).bitwiseAND(F.lit(BEGIN_BITS)) != 0)
    none = F.array().cast("array<int>")
    step = step.withColumn("starts", F.when(F.size("rolling") > 1, F.filter(F.sequence(F.lit(0), F.size("rolling") - 2), begins)).otherwise(none))
    ends = lambda i: (F.get("rolling", i - 1).bitwiseAND(F.lit(END_BITS)) != 0) | (i == F.size("rolling") - 1)

    def end(s: Column) -> Column:
        found = F.when(ends(s + 1), s + 1)
        for k in range(2, LONGEST - 1):
            found = found.when(ends(s + k), s + k)
        return found.otherwise(F.least(s + LONGEST - 1, F.size("rolling") - 1))

    step = step.withColumn("ends", F.when(F.size("starts") >= 0, F.transform("starts", end)))
    pair = lambda s, k: F.get("ends", k) == s + 1
    chunk = lambda s, k: F.when(pair(s, k), F.get("rolling", s)).otherwise(F.xxhash64(F.slice("line_hashes", s + 1, F.get("ends", k) - s + 1)))
    step = step.withColumn("hashes", F.when(F.size("ends") >= 0, F.transform("starts", chunk)))
    return step.drop("line_hashes", "rolling")


def _body(first: Column, last: Column, lines: str = "bare") -> Column:
    """The bytes that are compared: lines without the white space around them."""
    part = F.slice(lines, first + 1, last - first + 1)
    return F.array_join(part if lines == "bare" else F.transform(part, _bare_line), "\n")


def repeated_chunks(texts: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Two tables, and whether rows share an id: of each document doc_id, hashes (distinct), spots and lookup; of
    each chunk hash that several documents have hash and keeper (the smallest id).

    A spot is a chunk's first line, times 8, and how many lines follow it. With
    ``lookup`` there are none, as a chunk occurs twice or rows share the id."""
    chunks = with_chunks(with_lines(texts.where("doc_id is not null")), F.transform("lines", lambda x: F.xxhash64(_bare_line(x))))
    step = chunks.withColumn("distinct", F.array_distinct("hashes")).withColumn("lookup", F.size("distinct") < F.size("hashes"))
    spots = F.when(F.col("lookup") | (F.size("ends") < 1), F.array().cast("array<int>")).otherwise(F.zip_with("starts", "ends", lambda s, e: s * 8 + (e - s)))
    table = written(step.select("doc_id", F.col("distinct").alias("hashes"), spots.alias("spots"), "lookup"), "chunk-hashes")
    shared = table.groupBy("doc_id").count().where("count > 1")
    several_rows = not shared.isEmpty()
    if several_rows:
        shared = shared.select(F.col("doc_id").alias("shared_id"))
        table = table.join(shared, F.col("doc_id") == F.col("shared_id"), "left").withColumn("lookup", F.col("lookup") | F.col("shared_id").isNotNull())
        table = table.select("doc_id", "hashes", F.when(F.col("lookup"), F.array().cast("array<int>")).otherwise(F.col("spots")).alias("spots"), "lookup")
        table = written(table, "chunk-hashes")
    each = table.select("doc_id", F.explode("hashes").alias("hash"))
    several = each.groupBy("hash").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("other")).where("keeper != other").select("hash", "keeper")
    return table, written(several, "chunk-keepers", release=True), several_rows


def kept_chunks(texts: DataFrame, keepers: DataFrame) -> DataFrame:
    """hash and known (body, and the lines before and behind it up to the next chunk
    on each side, nearest first) of each chunk in the document that keeps it."""
    wanted = keepers.groupBy(F.col("keeper").alias("own_id")).agg(F.collect_list("hash").alias("wanted"))
    step = with_lines(texts.join(wanted.hint("shuffle_hash"), texts.doc_id == wanted.own_id).select("text", "wanted"))
    step = step.withColumn("bare", F.transform("lines", _bare_line)).withColumn("total", F.size("bare"))
    step = with_chunks(step, F.transform("bare", lambda x: F.xxhash64(x)))

    def known(c: Column) -> Column:
        k = c["k"]
        first, last = F.get("starts", k), F.get("ends", k)
        before, behind = F.coalesce(F.get("starts", k - 1), first) + 1, F.coalesce(F.get("ends", k + 1), F.col("total")) - 1
        # at the ends of this text chunks begin and end that elsewhere need not
        before = F.when(k == 1, F.get("starts", k - 1)).otherwise(before)
        behind = F.when(F.get("ends", k + 1) == F.col("total") - 1, F.col("total") - 1).otherwise(behind)
        left = F.reverse(F.slice("bare", before + 1, F.greatest(first - before, F.lit(0))))
        right = F.slice("bare", last + 2, F.greatest(behind - last, F.lit(0)))
        return F.when(k >= 0, F.struct(c["hash"].alias("hash"), F.struct(_body(first, last).alias("body"), left.alias("left"), right.alias("right")).alias("known")))

    # in order of hash and place, what stands behind a wanted hash is its first place in the document
    step = step.withColumn("order", _by_hash(F.transform("wanted", lambda h: F.struct(h.alias("hash"), F.lit(-1).alias("k")))))
    at = lambda i: F.get("order", i)
    first = lambda i: (at(i)["k"] >= 0) & (at(i - 1)["k"] < 0) & (at(i)["hash"] == at(i - 1)["hash"])
    step = step.withColumn("picked", F.when(F.size("order") > 1, F.filter(F.sequence(F.lit(1), F.size("order") - 1), first)))
    return step.select(F.explode(F.transform(F.transform("picked", at), known)).alias("c")).where("c is not null").select("c.hash", "c.known")


def _by_hash(others: Column) -> Column:
    """Hash and place (k) of the chunks of a text together with ``others``, whose
    k is negative, in order: equal hashes stand side by side, which no search through the
    text for each of its chunks is needed to find."""
    own = F.transform("hashes", lambda h, k: F.struct(h.alias("hash"), k.alias("k")))
    return F.sort_array(F.concat(others, own))


def removable(texts: DataFrame) -> DataFrame:
    """own_id, gone (spot, hash and known of the chunks that documents with smaller
    ids keep, by spot) and lookup of each document that has such chunks or has one
    twice."""
    table, keepers, several_rows = repeated_chunks(texts)
    known = kept_chunks(texts, keepers)
    if several_rows:  # the rows of an id may keep a chunk each
        known = known.dropDuplicates(["hash"])
    known = written(known, "kept-chunks", release=True)
    each = table.select("doc_id", F.inline(F.arrays_zip(F.col("hashes").alias("hash"), F.col("spots").alias("spot"))))
    found = each.join(keepers.hint("shuffle_hash"), "hash").where("doc_id != keeper").select("doc_id", "spot", F.col("hash").bitwiseXOR(F.lit(-1)).alias("own"))
    # the join's own key makes Spark shuffle both sides for it, so that it can split a chunk of many documents
    known = known.withColumn("own", F.col("hash").bitwiseXOR(F.lit(-1)))
    marks = found.join(known.hint("merge"), "own").select("doc_id", F.struct("spot", "hash", "known.*").alias("chunk"), F.lit(False).alias("lookup"))
    marks = marks.unionByName(table.where("lookup").select("doc_id", F.lit(None).cast(marks.schema["chunk"].dataType).alias("chunk"), "lookup"))
    return written(marks.groupBy(F.col("doc_id").alias("own_id")).agg(F.sort_array(F.collect_list("chunk")).alias("gone"), F.max("lookup").alias("lookup")), "removable", release=True)


def _once(value: Column, use) -> Column:
    """``use(value)``; inside a lambda Spark computes what is named several times
    each time, unless it is the variable of another lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(expected: Column, line) -> Column:
    """How many of the expected lines are the lines ``line(k)``, from the first on."""
    step = lambda a, x: F.when(a["on"] & (x == line(a["n"])), F.struct((a["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("on")))
    several = F.aggregate(expected, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), step, lambda a: a["n"])
    return F.when(F.get(expected, F.lit(0)) == line(F.lit(0)), F.when(F.size(expected) == 1, F.lit(1)).otherwise(several)).otherwise(F.lit(0))


def dedup_lines(docs: DataFrame, least_chars: int = 60, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of the text, as
    (doc_id, text, row, new_text, n_removed); ``row`` holds the other columns,
    ``n_removed`` counts lines."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rest = [c for c in docs.columns if c not in (id_column, text_column)]
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")] if rest else []))
    marks = removable(texts)
    step = rows.join(marks.hint("shuffle_hash"), rows.doc_id == marks.own_id, "left")
    # texts without a mark are not cut up again
    step = with_lines(step.withColumn("marked", F.when(F.col("own_id").isNotNull(), F.col("text"))), "marked")
    # where spots say nothing, chunks are made and looked up again; elsewhere only lines at spots are trimmed
    step = step.withColumn("bare", F.when(F.col("lookup"), F.transform("lines", _bare_line)))
    step = with_chunks(step, F.transform("bare", lambda x: F.xxhash64(x)))

    def stretched(k: Column, first: Column, last: Column, left: Column, right: Column, line) -> Column:
        """A chunk's place with the lines beside it that are as in ``left`` and ``right``."""
        before, behind = _matches(left, lambda j: line(first - 1 - j)), _matches(right, lambda j: line(last + 1 + j))
        return F.struct(k.alias("k"), (first - before).alias("first"), (last + behind).alias("last"))

    def at_spot(x: Column) -> Column:
        """The lines of a chunk and those beside it that stand beside the kept copy too."""
        first = F.shiftright(x["spot"], 3)
        last = first + x["spot"].bitwiseAND(F.lit(7))
        same = x["body"] == _body(first, last, "lines")
        return F.when(same, stretched(F.lit(0), first, last, x["left"], x["right"], lambda j: _bare_line(F.get("lines", j))))

    # where spots say nothing: a negative k tells the place in gone
    kept = F.transform("gone", lambda x, i: F.struct(x["hash"].alias("hash"), (-1 - i).alias("k")))
    step = step.withColumn("order", F.when(F.col("lookup"), _by_hash(kept)))
    hash_at = lambda i: F.get("order", i)["hash"]
    heads = F.filter(F.sequence(F.lit(0), F.size("order") - 1), lambda i: (i == 0) | (hash_at(i) != hash_at(i - 1)))
    step = step.withColumn("heads", F.when(F.size("order") > 0, heads))
    bare = lambda j: F.get("bare", j)

    def group(head: Column, n: Column) -> Column:
        """Chunks of one hash: those that stand as in the kept copy, and those that
        the text has further up."""
        size = F.coalesce(F.get("heads", n + 1), F.size("order")) - head
        lead = F.get("order", head)["k"]
        # the head is a kept copy, or the first chunk of the text; behind a kept copy the first is the next
        earlier = F.when(lead >= 0, lead).otherwise(F.get("order", head + 1)["k"])

        def model(k: Column) -> Column:
            """The kept copy, if any, and the earlier chunk with the lines up to the chunks beside it."""
            own, end = F.get("starts", k), F.get("ends", k)
            before, behind = F.coalesce(F.get("starts", k - 1), own), F.coalesce(F.get("ends", k + 1), F.size("lines") - 1)
            left = F.reverse(F.slice("bare", before + 1, F.greatest(own - before, F.lit(0))))
            right = F.slice("bare", end + 2, F.greatest(behind - end, F.lit(0)))
            known = F.when(lead < 0, F.get("gone", -1 - lead))
            return F.struct(k.alias("k"), F.slice("bare", own + 1, end - own + 1).alias("lines"), left.alias("left"), right.alias("right"), known.alias("known"))

        def found(x: Column, m: Column) -> Column:
            at = x["k"]
            first, last = F.get("starts", at), F.get("ends", at)
            whole = F.when(m["known"]["body"] == _body(first, last), stretched(at, first, last, m["known"]["left"], m["known"]["right"], bare))
            again = (m["k"] < at) & (m["k"] >= 0) & (m["lines"] == F.slice("bare", first + 1, last - first + 1))
            return F.when(at >= 0, F.coalesce(whole, F.when(again, stretched(at, first, last, m["left"], m["right"], bare))))

        places = lambda m: F.filter(F.transform(F.slice("order", head + 1, size), lambda x: found(x, m)), lambda x: x.isNotNull())
        return F.when(size > 1, _once(_once(earlier, model), places))

    looked_up = F.sort_array(F.flatten(F.filter(F.transform("heads", group), lambda g: g.isNotNull())))
    at_spots = F.filter(F.transform("gone", at_spot), lambda x: x.isNotNull())
    step = step.withColumn("out", F.when(F.size("lines") >= 0, F.when(F.size("heads") >= 0, looked_up).otherwise(at_spots)))
    # neither first nor last lines ever fall: lines beside a chunk end where the next chunk would
    begins = lambda k: (k == 0) | (F.get("out", k)["first"] > F.get("out", k - 1)["last"] + 1)
    step = step.withColumn("places", F.when(F.size("out") > 0, F.filter(F.sequence(F.lit(0), F.size("out") - 1), begins)))
    length = lambda a, r: F.get("out", F.coalesce(F.get("places", r + 1), F.size("out")) - 1)["last"] - F.get("out", a)["first"] + 1
    runs = F.transform("places", lambda a, r: F.struct(F.get("out", a)["first"].alias("at"), length(a, r).alias("n")))
    text = lambda at, n: F.array_join(F.slice("lines", at + 1, n), "")
    step = step.withColumn("runs", F.when(F.size("places") > 0, runs))
    step = step.withColumn("goes", F.when(F.size("lines") > 0, F.filter("runs", lambda r: F.length(_bare(text(r["at"], r["n"]))) >= least_chars)))
    step = step.withColumn("n_removed", F.coalesce(F.aggregate("goes", F.lit(0), lambda x, r: x + r["n"]), F.lit(0)))
    before = lambda k: F.when(k > 0, F.get("goes", k - 1)["at"] + F.get("goes", k - 1)["n"]).otherwise(0)
    behind = lambda k: F.coalesce(F.get("goes", k)["at"], F.size("lines"))
    new = F.array_join(F.transform(F.sequence(F.lit(0), F.size("goes")), lambda k: text(before(k), behind(k) - before(k))), "")
    return step.select("doc_id", "text", *(["row"] if rest else []), F.when(F.col("n_removed") > 0, new).otherwise(F.col("text")).alias("new_text"), "n_removed")


def without_repeated_lines(docs: DataFrame, least_chars: int = 60) -> DataFrame:
    """``docs`` with repeated passages cut out, columns as they were; ``n_chars``
    follows the text. A document of which nothing is left goes."""
    found = dedup_lines(docs, least_chars)
    # as an array of one row that is filtered: a plain filter would be pushed
    # below the projections and repeat all their expressions
    row = F.struct(*[F.col(c) for c in found.columns])
    found = found.select(F.inline(F.filter(F.array(row), lambda r: (r["n_removed"] == 0) | (F.btrim(r["new_text"], F.lit(AROUND)) != ""))))
    columns = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("new_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("new_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
