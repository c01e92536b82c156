"""Files and pages to text, parts of documents, and questions with answers taken from them."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from siltworks.functions.text import nz
from siltworks.operators.generation import RESPONSE, run_task
from siltworks.operators.scores import row_udf
from siltworks.operators.serving import Reply, ask
from siltworks.registry import register
from siltworks.runtime import require

# --- pages to Markdown


class _Markdown(HTMLParser):
    """HTML to Markdown: headings, lists, links, emphasis, code, tables as rows; scripts, styles and heads are left out."""

    SKIP = frozenset(("script", "style", "head", "noscript", "template"))
    BLOCK = frozenset(("p", "div", "section", "article", "header", "footer", "ul", "ol", "table", "tr", "blockquote", "pre", "main", "figure"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.lists: list[list] = []
        self.links: list[str] = []
        self.pre = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li":
            top = self.lists[-1] if self.lists else ["ul", 0]
            top[1] += 1
            self.out.append("\n" + "  " * (len(self.lists) - 1) + (f"{top[1]}. " if top[0] == "ol" else "- "))
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag in self.BLOCK:
            self.out.append("\n\n" if tag != "tr" else "\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[" if self.links[-1] else "")
        elif tag == "img":
            a = dict(attrs)
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag in ("td", "th"):
            self.out.append("| ")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag in self.BLOCK and tag != "tr":
            self.out.append("\n\n")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.links:
            link = self.links.pop()
            self.out.append(f"]({link})" if link else "")
        elif tag in ("td", "th"):
            self.out.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_to_markdown(page: str | None) -> str | None:
    """The page's text as Markdown; null for null."""
    if page is None:
        return None
    p = _Markdown()
    p.feed(page)
    p.close()
    lines = [x.rstrip() if x.startswith("    ") else x.strip() if not re.match(r"\s*(?:-|\d+\.) ", x) else x.rstrip() for x in "".join(p.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def xml_to_text(page: str | None) -> str | None:
    return None if page is None else "\n".join(x for x in (html.unescape(t).strip() for t in re.split(r"<[^>]*>", re.sub(r"(?s)<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>", "", page))) if x)


def _as_markdown(kind: Column, content: Column) -> Column:
    return row_udf(lambda k, c: html_to_markdown(c) if k == "html" else xml_to_text(c) if k == "xml" else c, T.StringType(), kind, content)


def kind_of(source: Column) -> Column:
    """What a path or address names: pdf, image, html, xml or text; an address without a known ending is html."""
    end = F.lower(F.regexp_extract(F.regexp_replace(nz(source), r"[?#].*$", ""), r"\.([A-Za-z0-9]{1,5})$", 1))
    return F.when(end == "pdf", "pdf").when(end.isin("png", "jpg", "jpeg", "webp", "gif", "bmp", "tif", "tiff"), "image").when(end.isin("html", "htm"), "html").when(end == "xml", "xml").when(end.isin("txt", "md", "json", "jsonl", "csv"), "text").when(nz(source).rlike(r"^(?i)https?://"), "html").otherwise("text")


@register("file_or_url_to_markdown_converter")
def to_markdown(df: DataFrame, source: str, content: str, output: str = "text", parse: Callable[[Column], Column] | None = None) -> DataFrame:
    """df with `kind` and the Markdown of each row's content (text of a page or file). parse: for PDFs and pictures, from their path; without it they have null.

    The local, remote and batched converters are this operator with their parser.
    """
    require(df, source, content)
    kind = kind_of(F.col(source))
    other = parse(F.col(source)) if parse else F.lit(None).cast("string")
    return df.withColumn("kind", kind).withColumn(output, F.when(F.col("kind").isin("pdf", "image"), other).otherwise(_as_markdown(F.col("kind"), F.col(content).cast("string"))))


for _way in ("api", "local", "flash"):
    register(f"file_or_url_to_markdown_converter_{_way}")(to_markdown)


def read_whole(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, content) of whole text files."""
    return spark.read.option("wholetext", "true").text(paths).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


# --- parts


@register("kbc_chunk_by_sentence")
def sentence_chunks(df: DataFrame, key: str, text: str, chunk_size: int = 512) -> DataFrame:
    """(key, chunk, raw_chunk): whole sentences, filled up to chunk_size words; a longer sentence is a chunk of its own."""
    require(df, key, text)
    s = F.filter(F.transform(F.split(nz(text), r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+"), F.trim), lambda x: x != "")
    each = F.transform(s, lambda x: F.struct(x.alias("s"), F.size(F.split(x, r"\s+")).alias("n")))
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("n"), F.array().cast("array<struct<c:int,s:string>>").alias("all"))

    def add(a: Column, x: Column) -> Column:
        fresh = (a["n"] > 0) & (a["n"] + x["n"] > chunk_size)
        c = F.when(fresh, a["c"] + 1).otherwise(a["c"])
        return F.struct(c.alias("c"), F.when(fresh, x["n"]).otherwise(a["n"] + x["n"]).alias("n"), F.concat(a["all"], F.array(F.struct(c.alias("c"), x["s"].alias("s")))).alias("all"))

    placed = df.select(key, F.posexplode(F.aggregate(each, zero, add, lambda a: a["all"])).alias("_i", "_x"))
    got = placed.groupBy(key, F.col("_x.c").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("_i", F.col("_x.s").alias("s")))).alias("_s"))
    return got.select(key, "chunk", F.array_join(F.col("_s.s"), " ").alias("raw_chunk"))


@register("kbc_chunk_recursive")
def recursive_chunks(df: DataFrame, key: str, text: str, chunk_size: int = 2048) -> DataFrame:
    """(key, chunk, raw_chunk) of at most chunk_size characters: cut at blank lines, what is longer at line ends, then at sentences, then at spaces, then anywhere."""
    require(df, key, text)

    def cut(t: str, level: int = 0) -> list[str]:
        if len(t) <= chunk_size:
            return [t] if t.strip() else []
        if level == len(marks):
            return [t[i : i + chunk_size] for i in range(0, len(t), chunk_size)]
        out, held = [], ""
        for piece in re.split(marks[level], t):
            if len(held) + len(piece) + 1 <= chunk_size:
                held = f"{held}{glue[level]}{piece}" if held else piece
                continue
            if held:
                out.append(held)
            held = ""
            if len(piece) <= chunk_size:
                held = piece
            else:
                out += cut(piece, level + 1)
        return [x for x in [*out, held] if x.strip()]

    marks, glue = (r"\n\s*\n", r"\n", r"(?<=[.!?。！？])\s*", r" +"), ("\n\n", "\n", " ", " ")

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([cut(t) if isinstance(t, str) else [] for t in texts], dtype=object)

    return df.select(key, F.posexplode(run(F.col(text))).alias("chunk", "raw_chunk"))


@register("kbc_chunk_generator_batch")
def chunk_files(spark: SparkSession, paths: list[str] | str, folder: str, chunk: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(path, chunk_path): the chunks of each file, written below folder by the file's hash. chunk: (path, content) -> (path, chunk, raw_chunk)."""
    got = chunk(read_whole(spark, paths)).withColumn("file", F.md5("path"))
    got.write.mode("overwrite").partitionBy("file").json(folder)
    return spark.read.json(folder).select("path", F.concat(F.lit(f"{folder.rstrip('/')}/file="), "file").alias("chunk_path")).distinct()


def _over_chunk_files(spark: SparkSession, folder: str, out: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    work(spark.read.json(folder)).write.mode("overwrite").partitionBy("file").json(out)
    return spark.read.json(out).select("path", F.concat(F.lit(f"{out.rstrip('/')}/file="), "file").alias("chunk_path")).distinct()


@register("kbc_text_cleaner_batch")
def clean_chunk_files(spark: SparkSession, folder: str, out: str, reply: Reply) -> DataFrame:
    """kbc_text_cleaner over the files of chunk_files; (path, chunk_path) of the new files."""
    return _over_chunk_files(spark, folder, out, lambda d: run_task(d, "kbc_text_cleaner", reply))


@register("kbc_multihop_qa_generator_batch")
def multihop_chunk_files(spark: SparkSession, folder: str, out: str, reply: Reply, text: str = "raw_chunk") -> DataFrame:
    """text2multihopqa over the files of chunk_files; (path, chunk_path) of the new files."""
    from siltworks.operators.generation import text2multihopqa

    def work(d: DataFrame) -> DataFrame:
        d = d.withColumn("_k", F.concat_ws("-", "file", "chunk"))
        return d.join(text2multihopqa(d, "_k", reply, text), "_k").drop("_k")

    return _over_chunk_files(spark, folder, out, work)


# --- questions and answers


@register("qa_extractor")
def extract_qa(df: DataFrame, qa: str = "QA_pairs", instruction: str = "Please answer the following question based on the provided information.", names: tuple[str, str, str] = ("instruction", "input", "output")) -> DataFrame:
    """(instruction, input, output) of each pair with a question and an answer. qa: a JSON text or column of a list of pairs, or of an object with `qa_pairs`; extra fields don't matter."""
    require(df, qa)
    if dict(df.dtypes)[qa] != "string":
        df = df.withColumn(qa, F.to_json(qa))
    kind = "array<struct<question:string,answer:string>>"
    plain, inner = F.from_json(qa, kind), F.from_json(F.get_json_object(qa, "$.qa_pairs"), kind)
    one = F.array(F.from_json(qa, "struct<question:string,answer:string>"))
    pairs = F.when(F.trim(qa).startswith("["), plain).when(F.get_json_object(qa, "$.qa_pairs").isNotNull(), inner).otherwise(one)
    got = df.select(F.explode(pairs).alias("q")).select(F.trim("q.question").alias("q"), F.trim("q.answer").alias("a")).filter((F.length("q") > 0) & (F.length("a") > 0))
    return got.select(F.lit(instruction).alias(names[0]), F.col("q").alias(names[1]), F.col("a").alias(names[2]))


@register("layout_to_llm_input_operator")
def flatten_layout(df: DataFrame, key: str, layout: str, output: str = "layout") -> DataFrame:
    """(key, id, type, text, img_path): the items of a layout list (JSON), text lists divided into their items, numbered again from 0; places on the page are left out."""
    require(df, key, layout)
    items = F.from_json(layout, "array<struct<type:string,sub_type:string,text:string,img_path:string,image_caption:array<string>,list_items:array<string>>>")
    flat = F.flatten(F.transform(items, lambda x: F.when((x["type"] == "list") & (x["sub_type"] == "text"), F.transform(F.coalesce(x["list_items"], F.array().cast("array<string>")), lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"), F.lit(None).cast("string").alias("img_path"), F.lit(None).cast("array<string>").alias("caption")))).when(x["type"] == "list", F.array().cast("array<struct<type:string,text:string,img_path:string,caption:array<string>>>")).otherwise(F.array(F.struct(x["type"].alias("type"), x["text"].alias("text"), x["img_path"].alias("img_path"), x["image_caption"].alias("caption"))))))
    return df.select(key, F.posexplode(flat).alias("id", "x")).select(key, "id", "x.*")


@register("llm_output_parser")
def parse_llm_output(df: DataFrame, key: str, response: str, layout: DataFrame, image_prefix: str = "images") -> DataFrame:
    """(key, n, chapter_title, label, question, answer, solution) of each <qa_pair> in a response; lists of ids become the texts of the layout's items.

    layout: rows of flatten_layout. A pair needs a label and a question, an answer or a solution. Ids that aren't numbers or aren't in the layout are left out.
    """
    require(df, key, response)
    inner = lambda c, t: F.trim(F.regexp_extract(c, rf"(?s)<{t}>(.*?)</{t}>", 1))
    chapters = df.select(key, F.posexplode(F.regexp_extract_all(nz(response), F.lit(r"(?s)<chapter>(.*?)</chapter>"), F.lit(1))).alias("_c", "_x"))
    pairs = chapters.select(key, "_c", inner(F.col("_x"), "title").alias("_title"), F.posexplode(F.regexp_extract_all("_x", F.lit(r"(?s)<qa_pair>(.*?)</qa_pair>"), F.lit(1))).alias("_q", "_p"))
    some = lambda t: F.col("_p").rlike(rf"(?s)<{t}>.*?</{t}>")
    pairs = pairs.filter(some("label") & (some("question") | some("answer") | some("solution")))
    pairs = pairs.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("_c", "_q"))).withColumns({"label": inner(F.col("_p"), "label"), "answer": inner(F.col("_p"), "answer"), "question": inner(F.col("_p"), "question"), "solution": inner(F.col("_p"), "solution")})
    lists = pairs.select(key, "n", F.explode(F.array(*[F.struct(F.lit(name).alias("part"), F.col(c).alias("ids")) for name, c in (("chapter_title", "_title"), ("question", "question"), ("solution", "solution"))])).alias("l")).select(key, "n", "l.part", F.posexplode(F.split(F.regexp_replace("l.ids", " ", ""), ",")).alias("_i", "id"))
    lists = lists.withColumn("id", F.col("id").try_cast("int")).filter(F.col("id").isNotNull())
    picture = F.concat(F.lit("!["), F.coalesce(F.array_join("caption", " "), F.lit("image")), F.lit(f"]({image_prefix}/"), F.regexp_extract("img_path", r"([^/]*)$", 1), F.lit(")"))
    said = lists.join(layout.select(key, "id", F.coalesce("text", F.when(F.length("img_path") > 0, picture)).alias("_t")), [key, "id"]).filter(F.col("_t").isNotNull())
    texts = said.groupBy(key, "n", "part").agg(F.sort_array(F.collect_list(F.struct("_i", "_t"))).alias("_ts")).select(key, "n", "part", F.array_join(F.col("_ts._t"), "\n").alias("_text"))
    wide = texts.groupBy(key, "n").pivot("part", ["chapter_title", "question", "solution"]).agg(F.first("_text"))
    return pairs.select(key, "n", "label", "answer").join(wide, [key, "n"], "left").select(key, "n", *[F.coalesce(c, F.lit("")).alias(c) for c in ("chapter_title", "label", "question", "answer", "solution")])


def plain_title(title: Column, strict: bool = False) -> Column:
    """A chapter's title for comparing: without spaces; unless strict, its number if it has one."""
    t = F.regexp_replace(nz(title), r"\s+", "")
    if strict:
        return t
    n = F.regexp_extract(t, r"(\d+(?:\.\d+)*)", 1)
    han = F.regexp_extract(t, r"[第]?([一二三四五六七八九十]+)[章节]?", 1)
    return F.when(n != "", n).when(han != "", han).otherwise(t)


@register("qa_merger")
def merge_qa(items: DataFrame, name: str, order: str, strict: bool = False) -> DataFrame:
    """(name, chapter_title, label, question, answer, solution): complete pairs, and questions joined with the answers of the same chapter and label.

    items: (name, order, chapter_title, label, question, answer, solution), a row with a question is a question, any other an answer.
    A label is its first number; rows without one or with 0 are left out. An empty title is that of the row before; a title that
    changes while the label goes on rising is a sub-title and doesn't count. Of several answers each part is the first one given
    that isn't empty; of several questions the last counts.
    """
    require(items, name, order, "chapter_title", "label", "question", "answer", "solution")
    rows = items.withColumn("label", F.nullif(F.regexp_extract(nz("label").cast("string"), r"(\d+)", 1), F.lit("")).try_cast("bigint")).filter(F.col("label").isNotNull()).withColumn("_ask", nz("question") != "")
    w = W.partitionBy(name, "_ask").orderBy(order)
    # a title begins a chapter where the label doesn't rise
    head = F.col("label") <= F.coalesce(F.lag("label").over(w), F.lit(2**62))
    begins = F.when((nz("chapter_title") != "") & head, F.col("chapter_title"))
    rows = rows.withColumn("_title", begins).withColumn("_title", F.coalesce(F.last("_title", True).over(w), nz("chapter_title"))).withColumn("_t", plain_title(F.col("_title"), strict)).filter("label > 0")
    whole = rows.filter(F.col("_ask") & ((nz("answer") != "") | (nz("solution") != ""))).select(name, F.col("_title").alias("chapter_title"), "label", "question", nz("answer").alias("answer"), nz("solution").alias("solution"))
    asked = rows.filter(F.col("_ask") & (nz("answer") == "") & (nz("solution") == "")).groupBy(name, "_t", "label").agg(F.max_by("question", order).alias("question"), F.max_by("_title", order).alias("chapter_title"))
    first = lambda c: F.min_by(F.col(c), F.when(nz(c) != "", F.col(order)))
    told = rows.filter(~F.col("_ask")).groupBy(name, "_t", "label").agg(first("answer").alias("answer"), first("solution").alias("solution"))
    joined = asked.join(told, [name, "_t", "label"]).select(name, "chapter_title", "label", "question", nz("answer").alias("answer"), nz("solution").alias("solution"))
    return whole.unionByName(joined)


@register("pdf_merger")
def merge_files(df: DataFrame, name: str, paths: str, merge: Callable[[str, list[str]], str], output: str = "merged_path") -> DataFrame:
    """df with the path of one file made of each row's list of files; merge(name, paths) runs on executors and gives the path."""
    require(df, name, paths)

    @F.pandas_udf("string")
    def run(names: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([merge(n, list(p)) if p is not None and len(p) else None for n, p in zip(names, lists)], dtype=object)

    return df.withColumn(output, run(F.col(name), F.col(paths)))


@register("math_book_question_extract")
def book_questions(pages: DataFrame, key: str, page: str, content: str, reply: Reply) -> DataFrame:
    """(key, page, question, answer): the questions that the model reads on each page (its path or text), from a JSON list."""
    require(pages, key, page, content)
    got = ask(pages, "List the exercises of this page as JSON objects with question and answer.\n{" + content + "}", RESPONSE, reply)
    items = F.from_json(F.regexp_extract(F.coalesce(RESPONSE, F.lit("")), r"(?s)(\[.*\])", 1), "array<struct<question:string,answer:string>>")
    return got.select(key, page, F.explode(items).alias("q")).select(key, page, F.trim("q.question").alias("question"), F.trim("q.answer").alias("answer")).filter(F.length("question") > 0)
