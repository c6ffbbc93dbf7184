"""Converting and combining files, many at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import ordered, texts
from quire.plans import merge
from quire.sources import files, packages, sinks, tables, word97_body

PARAGRAPH = ["path", "pos", "text", "kind", "level", "num", "label"]


def as_paragraphs(found: DataFrame, keep: Callable[..., DataFrame] = tables.saved) -> DataFrame:
    """(path, pos, text, kind, level, num, label) of text, Word and package files (path, content, format), list labels as shown.

    ``keep`` writes the elements of packages, which several steps read.
    """
    plain = lambda df: df.select("path", "pos", "text", F.lit("normal").alias("kind"), F.lit(0).alias("level"), F.lit(None).cast("int").alias("num"), F.lit(None).cast("string").alias("label"))
    of_text = plain(texts.paragraphs(files.text_files(found), "path", "text"))
    of_word = plain(texts.paragraphs(files.word97_texts(found).where("error is null"), "path", "text"))
    shredded = keep(files.elements(files.package_parts(found, files.XML)), "elements")
    read = files.paragraphs(shredded).select("path", "pos", "text", "kind", "style_level", "num", "level")
    labelled = ordered.list_labels(read, files.list_levels(shredded), ["path"], "pos", level_keys=["path"])
    of_package = labelled.select("path", "pos", "text", "kind", F.coalesce("level", "style_level").alias("level"), "num", "label")
    return of_text.unionByName(of_word).unionByName(of_package)


def word97_blocks(found: DataFrame, keep: Callable[..., DataFrame] = tables.saved) -> DataFrame:
    """(path, pos, text, kind, level, num, label, xml): paragraphs and tables of Word 97 files, their looks in ``xml``.

    Pictures are left out; a table stands where its first paragraph stood, with what its cells hold as text.
    """
    read = word97_body.kinds(keep(word97_body.body(found), "word97"))
    prop = lambda r, name, before, after: F.coalesce(F.concat(F.lit(before), r[name].cast("string"), F.lit(after)), F.lit(""))
    font = lambda r: F.when(r["font"] != "", F.concat(F.lit('<w:rFonts w:ascii="'), packages.attribute(r["font"]), F.lit('" w:hAnsi="'), packages.attribute(r["font"]), F.lit('"/>')))
    looks = lambda r: F.concat(F.coalesce(font(r), F.lit("")), F.when(r["strike"], "<w:strike/>").otherwise(""), prop(r, "colour", '<w:color w:val="', '"/>'), prop(r, "half_points", '<w:sz w:val="', '"/>'))
    page = lambda r: F.when(r["kind"] == "page", '<w:br w:type="page"/>')
    shown = F.transform(F.filter("runs", lambda r: r["kind"] != "picture"), lambda r: F.struct(r["text"].alias("text"), *[r[n].alias(n) for n in ("bold", "italic", "underline", "highlight")], F.when(r["kind"] == "page", "").otherwise(looks(r)).alias("props"), page(r).alias("drawing")).cast(packages.RUN))
    styles = F.array(*map(F.lit, sinks.LOOKS))
    null = lambda kind: F.lit(None).cast(kind)
    lines = read.where("depth = 0").select(
        "path", F.col("paragraph").alias("pos"), "kind", F.col("kind_level").alias("level"), F.when(F.col("align") != "left", F.col("align")).alias("align"), shown.alias("runs"),
        null("struct<kind:string,level:int>").alias("base_kind"), null("string").alias("origin"), null("int").alias("num"), styles.alias("styles"), F.lit(1).alias("bullet"),
    )
    made = packages.paragraphs_xml(lines).select("path", "pos", F.col("made").alias("xml"))
    cells = word97_body.cells(read).where("depth = 1").select("path", F.col("first").alias("pos"), "row", F.col("cell").alias("col"), "text", F.lit(1).alias("span"), F.lit(False).alias("merged"), null("string").alias("shade"))
    blocks = made.unionByName(packages.table_xml(cells, ["path", "pos"]))
    return blocks.select("path", "pos", F.lit("").alias("text"), F.lit("normal").alias("kind"), F.lit(0).alias("level"), null("int").alias("num"), null("string").alias("label"), "xml")


def as_blocks(found: DataFrame, keep: Callable[..., DataFrame] = tables.saved) -> DataFrame:
    """``as_paragraphs`` for a package: Word 97 files with their looks and tables. A readable one without text is one empty paragraph."""
    others = as_paragraphs(found.where("format <> 'doc'"), keep).withColumn("xml", F.lit(None).cast("string"))
    word = word97_blocks(found.where("format = 'doc'"), keep)
    empty = files.word97_texts(found).where("text = ''").select("path", F.lit(0).cast("long").alias("pos"), F.lit("").alias("text"), F.lit("normal").alias("kind"), F.lit(0).alias("level"), F.lit(None).cast("int").alias("num"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("xml"))
    return others.unionByName(word).unionByName(empty)


def convert(found: DataFrame, target: str) -> DataFrame:
    """(path, content, error): each file as text or docx; a file of that format comes back as it is.

    PDFs are not converted, and nothing becomes a PDF or a Word 97 file: such rows and files of no
    known format have an error and no content. Word 97 files keep their looks and tables in a package; as
    text, their cells are apart by tabs. The result is a written table (``tables.release``).
    """
    if target not in ("text", "docx"):
        raise ValueError(f"no sink for {target}")
    same = found.where(F.col("format") == target).select("path", "content", F.lit(None).cast("string").alias("error"))
    why = F.when(F.col("format") == "pdf", "a PDF cannot be turned into another format").otherwise("not a PDF, Word document or text file")
    refused = found.where("format is null or format = 'pdf'").select("path", F.lit(None).cast("binary").alias("content"), why.alias("error"))
    rest = found.where(F.col("format").isin("text", "docx", "doc") & (F.col("format") != target))
    with tables.steps(found.sparkSession) as keep:
        if target == "text":
            made = texts.text_of(as_paragraphs(rest, keep), ["path"], "label", "level").select("path", F.encode("text", "UTF-8").alias("content"))
        else:
            made = sinks.packages(as_blocks(rest, keep), ["path"])
        done = rest.select("path").join(made, "path", "left").select("path", "content", F.when(F.col("content").isNull(), "the file could not be read").alias("error"))
        return tables.saved(same.unionByName(refused).unionByName(done), "converted")


def combine(found: DataFrame) -> DataFrame:
    """(job, content, error): the files of each job (job, file_no, path, content, format) as one package, in order of file_no.

    Packages go over as they are, with their tables, looks, pictures, lists and all that they refer to;
    text and Word 97 files become packages first. Each later file begins on a new page. A job of fewer
    than two files, with a PDF or with an unreadable file has an error instead. The result is a written
    table (``tables.release``).
    """
    unreadable = files.package_parts(found.where("format = 'docx'")).where("error is not null").select("path").distinct()
    told = found.join(unreadable.withColumn("bad", F.lit(True)), "path", "left").groupBy("job").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(F.col("format") == "pdf", F.lit(False))).alias("pdf"), F.bool_or(F.col("format").isNull()).alias("unknown"), F.bool_or(F.coalesce("bad", F.lit(False))).alias("bad")
    )
    error = F.when(F.col("n") < 2, "combining takes two files at least").when(F.col("pdf"), "no PDF sink").when(F.col("unknown"), "not a PDF, Word document or text file").when(F.col("bad"), "a file could not be read")
    with tables.steps(found.sparkSession) as keep:
        told = keep(told.select("job", error.alias("error")), "jobs")
        taken = keep(found.join(told.where("error is null").select("job"), "job").withColumn("key", F.to_json(F.struct("job", "file_no"))), "files")
        others = taken.where("format <> 'docx'").select(F.col("key").alias("path"), "content", "format")
        made = sinks.packages(as_blocks(others, keep), ["path"]).withColumnRenamed("path", "key")
        ready = taken.where("format = 'docx'").select("job", "file_no", "content").unionByName(taken.where("format <> 'docx'").select("job", "file_no", "key").join(made, "key").select("job", "file_no", "content"))
        order = F.row_number().over(Window.partitionBy("job").orderBy("file_no")) - 1
        complete = keep(ready.withColumn("file_no", order), "ready")
        joined = merge.merge(complete)
        short = taken.groupBy("job").agg(F.count(F.lit(1)).alias("n")).join(complete.groupBy("job").agg(F.count(F.lit(1)).alias("k")), "job", "left").where("n > coalesce(k, 0)").select("job", F.lit("a file could not be read").alias("lacks"))
        out = told.join(joined, "job", "left").join(short, "job", "left")
        return tables.saved(out.select("job", F.when(F.col("lacks").isNull(), F.col("content")).alias("content"), F.coalesce("error", "lacks").alias("error")), "combined")
