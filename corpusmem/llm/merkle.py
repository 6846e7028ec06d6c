"""Document fingerprints: a Merkle tree over sections and paragraphs, in built-in functions only.

A text is cut into sections (at exactly two line feeds), paragraphs (lines) and phrases. A paragraph's hash is that of its
own whole text, a section hashes its paragraphs, the root its sections; cuts lose no character, so roots are equal only
where texts are. Below each paragraph stand short hashes of its phrases, for likeness alone: phrases end after a space
that follows one of a few letters or marks, so that an edit moves no boundary beyond its own neighbourhood; runs without
such a place are cut every 200 characters. The fingerprint is the root followed by the tree:

    root/paragraphleafleaf,paragraphleaf|paragraphleafleafleaf      ('|' between sections, ',' between paragraphs)

with 64, 32 and 8 hex digits for root, paragraph and leaf. Inner hashes can be recomputed from it, so two fingerprints are
compared from the root downward: equal branches are not entered, and the branches that differ locate the edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmem.llm.util import stored

_MARK = "\x01"
#: After these, a space ends a phrase; and a phrase never exceeds so many characters.
_ENDS = r"([.!?;:,dkz]) "
_LONG = "([^\x01\n]{200})"


def _leaves(paragraph: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(paragraph, F.lit(_ENDS), F.lit(f"$1 {_MARK}")), F.lit(_LONG), F.lit(f"$1{_MARK}"))
    phrases = F.filter(F.split(marked, _MARK), lambda p: p != "")
    return F.array_join(F.transform(phrases, lambda p: F.substring(F.md5(p.cast("binary")), 1, 8)), "")


def tree(text: Column) -> Column:
    """Hashes and leaves of all paragraphs in the tree's shape; null texts are empty."""
    paragraph = lambda p: F.concat(F.substring(F.sha2(p.cast("binary"), 256), 1, 32), _leaves(p))
    sections = F.split(F.coalesce(text, F.lit("")), "\n\n")
    return F.array_join(F.transform(sections, lambda s: F.array_join(F.transform(F.split(s, "\n"), paragraph), ",")), "|")


def root(shape: Column) -> Column:
    """The root's hash, from the paragraphs upward."""
    section = lambda s: F.sha2(F.array_join(F.transform(F.split(s, ","), lambda p: F.substring(p, 1, 32)), "").cast("binary"), 256)
    return F.sha2(F.array_join(F.transform(F.split(shape, r"\|"), section), "").cast("binary"), 256)


def fingerprint(text: Column) -> Column:
    """root/tree of a text. Equal texts have equal fingerprints, unequal ones unequal roots."""
    return with_root(tree(text))


def with_root(shape: Column) -> Column:
    return _let(shape, lambda s: F.concat(root(s), F.lit("/"), s))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _shape(print_: Column) -> Column:
    return F.substring(print_, 66, 2_000_000_000)


def _trimmed(a: Column, b: Column):
    """A struct of two arrays without the members that they have in common at the start and at the end."""

    def ahead(x: Column, y: Column, most: Column) -> Column:
        apart = F.filter(F.sequence(F.lit(0), most), lambda i: (i == most) | (F.get(x, i) != F.get(y, i)))
        return F.get(apart, F.lit(0))

    def cut(v: Column) -> Column:
        n, m = F.size(v["a"]), F.size(v["b"])
        start = ahead(v["a"], v["b"], F.least(n, m))
        # the longest common end of what the start leaves
        return _let(F.struct(v["a"], v["b"], start.alias("s")), lambda w: _let(
            F.struct(w["a"], w["b"], w["s"], F.reverse(w["a"]).alias("ra"), F.reverse(w["b"]).alias("rb")),
            lambda r: _let(F.struct(r["a"], r["b"], r["s"], ahead(r["ra"], r["rb"], F.least(F.size(r["a"]), F.size(r["b"])) - r["s"]).alias("e")), lambda z: F.struct(
                F.slice(z["a"], z["s"] + 1, F.size(z["a"]) - z["s"] - z["e"]).alias("a"), F.slice(z["b"], z["s"] + 1, F.size(z["b"]) - z["s"] - z["e"]).alias("b"),
            )),
        ))

    return _let(F.struct(a.alias("a"), b.alias("b")), cut)


def _common(a: Column, b: Column) -> Column:
    """How many leaves two lists have in common, repeats counted: one pass over both, sorted together."""
    marked = F.sort_array(F.concat(F.transform(a, lambda x: F.concat(x, F.lit("a"))), F.transform(b, lambda x: F.concat(x, F.lit("b")))))

    def step(acc: Column, v: Column) -> Column:
        leaf, left = F.substring(v, 1, 8), F.when(acc["leaf"] == F.substring(v, 1, 8), acc["left"]).otherwise(0)
        first = v.endswith("a")
        return F.struct(leaf.alias("leaf"), F.when(first, left + 1).otherwise(F.greatest(left - 1, F.lit(0))).alias("left"), (acc["same"] + F.when(~first & (left > 0), 1).otherwise(0)).alias("same"))

    return F.aggregate(marked, F.struct(F.lit("").alias("leaf"), F.lit(0).alias("left"), F.lit(0).alias("same")), step)["same"]


def _leaf_list(paragraphs: Column) -> Column:
    """All leaves of paragraphs."""
    flat = F.array_join(F.transform(paragraphs, lambda p: F.substring(p, 33, 2_000_000_000)), "")
    return F.filter(F.split(flat, r"(?<=\G.{8})"), lambda x: x != "")


def _count(shape: Column) -> Column:
    """How many leaves a tree has."""
    marks = F.length(shape) - F.length(F.translate(shape, ",|", ""))
    return ((F.length(shape) - 33 * (marks + 1) + 1) / 8).cast("int")


def likeness(a: Column, b: Column) -> Column:
    """1 where roots are equal, else the Dice share of leaves (with repeats, and the roots as one each) in common.

    Sections in common at the start and the end are not entered, nor are such paragraphs of the others; only leaves of
    the paragraphs that are left are compared.
    """

    def descend(v: Column) -> Column:
        sections = _trimmed(F.split(v["x"], r"\|"), F.split(v["y"], r"\|"))
        inner = _let(sections, lambda s: _trimmed(F.split(F.array_join(s["a"], ","), ","), F.split(F.array_join(s["b"], ","), ",")))
        lists = _let(inner, lambda p: F.struct(_leaf_list(p["a"]).alias("a"), _leaf_list(p["b"]).alias("b")))
        same = _let(lists, lambda q: v["n"] - F.size(q["a"]) + F.when((F.size(q["a"]) == 0) | (F.size(q["b"]) == 0), F.lit(0)).otherwise(_common(q["a"], q["b"])))
        return 2.0 * same / (v["n"] + v["m"] + 2)

    x, y = _shape(a), _shape(b)
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).otherwise(_let(F.struct(x.alias("x"), y.alias("y"), _count(x).alias("n"), _count(y).alias("m")), descend))


def edits(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: (section, paragraph) places, from 0, of paragraphs whose hashes differ.

    Sections with equal hashes are not entered; a paragraph that only one side has differs.
    """

    def places(v: Column) -> Column:
        differ = F.filter(F.sequence(F.lit(0), F.greatest(F.size(v["x"]), F.size(v["y"])) - 1), lambda i: ~F.get(v["x"], i).eqNullSafe(F.get(v["y"], i)))
        return F.flatten(F.transform(differ, lambda i: _let(F.struct(F.split(F.get(v["x"], i), ",").alias("x"), F.split(F.get(v["y"], i), ",").alias("y")), lambda w: inside(w, i))))

    def inside(w: Column, i: Column) -> Column:
        n = F.greatest(F.coalesce(F.size(w["x"]), F.lit(0)), F.coalesce(F.size(w["y"]), F.lit(0)))
        found = F.filter(F.sequence(F.lit(0), n - 1), lambda j: ~F.get(w["x"], j).eqNullSafe(F.get(w["y"], j)))
        return F.transform(found, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    return _let(F.struct(F.split(_shape(a), r"\|").alias("x"), F.split(_shape(b), r"\|").alias("y")), places)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, prev, need): for every distinct non-null id the id before it in ascending order (before the first: the last)
    and how many characters of this text the longest row of the one before may need, floor(n_chars / 4).

    Ids are dealt by range, so that no window holds all of them; the ends of ranges meet through one row a range.
    """
    sized = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.coalesce(F.length(text_col), F.lit(0))).alias("n"))
    dealt = stored(sized.repartitionByRange(F.col("id")).withColumn("part", F.spark_partition_id()))
    own = W.partitionBy("part").orderBy("id")
    ends = dealt.groupBy("part").agg(F.max(F.struct("id", "n")).alias("last"))
    before = ends.select("part", F.lag("last").over(W.orderBy("part")).alias("end"), F.max("last").over(W.partitionBy()).alias("very_last"))
    here = dealt.withColumn("p", F.lag(F.struct("id", "n")).over(own)).join(before, "part")
    prev = F.coalesce("p", "end", "very_last")
    return stored(here.select("id", prev["id"].alias("prev"), F.floor(prev["n"] / 4).cast("int").alias("need")))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edits). The edited text has
    its last floor(n_chars / 4) characters replaced by the first as many of the next document by id (after the last,
    the first). Null texts are empty. Of rows with one id, each is a document; as a "next" document the smallest of
    their texts stands for them. A row with a null id has itself as the next. One document is its own next.
    edits are the places where the document and its edited text differ, `section.paragraph` from 0, a space between.
    No row is lost: where an input gives other ids each time it is read, a document may lack its next one, which then
    counts as empty. Texts are shuffled by id once; only the heads that the document before needs and a fingerprint go
    with it. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    near = neighbours(docs, id_col, text_col)
    # both joins below read one exchange of texts and fingerprints by id
    keyed = rows.where("id is not null").withColumn("print", fingerprint(F.col("text")))
    heads = keyed.join(near, "id").groupBy("prev").agg(F.min(F.struct(F.expr("substring(text, 1, need)").alias("head"), F.col("print").alias("next_print"))).alias("h"))
    heads = heads.select(F.col("prev").alias("id"), F.col("h.head").alias("head"), F.col("h.next_print").alias("next_print"))
    nobody = rows.where("id is null").withColumn("print", fingerprint(F.col("text"))).withColumn("head", F.col("text")).withColumn("next_print", F.col("print"))
    missing = fingerprint(F.lit(""))
    joined = keyed.join(heads, "id", "left").withColumn("head", F.coalesce("head", F.lit(""))).withColumn("next_print", F.coalesce("next_print", missing)).select(nobody.columns).union(nobody).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))"), F.expr("substring(head, 1, cast(floor(n_chars / 4) as int))"))
    out = joined.select("id", "n_chars", edited.alias("edited"), "print", "next_print")
    out = out.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "print", "next_print", fingerprint(F.col("edited")).alias("edited_print"))
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", F.col("print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        F.array_join(F.transform(edits(F.col("print"), F.col("edited_print")), lambda e: F.concat(e["section"].cast("string"), F.lit("."), e["paragraph"].cast("string"))), " ").alias("edits"),
    )
