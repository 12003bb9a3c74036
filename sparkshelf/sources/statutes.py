"""Statutes from recursive tag trees (one JSON file each) to a table of paragraphs, and a generated stand-in."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from sparkshelf.functions import text as T
from sparkshelf.functions.numerals import int_to_kanji

#: Tags whose text is numbering or headings, not provision text; fixed values.
NOT_BODY = frozenset({"ParagraphNum", "ItemTitle", "Subitem1Title", "Subitem2Title", "Subitem3Title", "Subitem4Title", "ArticleTitle", "ArticleCaption", "ParagraphCaption"})
#: White space of the format; fixed value.
SPACE = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ROW = "law_id string, law_num string, title string, article_pos int, article string, caption string, label string, chapter string, section string, paragraph_pos int, paragraph string, text string, in_main boolean"


def _children(node: dict, tag: str | None = None) -> list[dict]:
    return [c for c in node.get("children") or [] if isinstance(c, dict) and (tag is None or c.get("tag") == tag)]


def _find(node: dict, tag: str) -> dict | None:
    if node.get("tag") == tag:
        return node
    return next((f for c in _children(node) if (f := _find(c, tag))), None)


def _text(node: dict | None, body: bool) -> str:
    if node is None:
        return ""
    return "".join(c if isinstance(c, str) else "" if not isinstance(c, dict) or body and c.get("tag") in NOT_BODY else _text(c, body) for c in node.get("children") or [])


def _heading(node: dict | None) -> str | None:
    return None if node is None else _text(node, False).strip(SPACE) or None


def _without_space(text: str) -> str:
    return text.translate(dict.fromkeys(map(ord, SPACE)))


def paragraphs(raw: str) -> Iterator[tuple]:
    """Rows of a law; articles of supplementary provisions come with in_main false and without text.

    A file may be the tree alone; then number and title come from the tree.
    """
    law = json.loads(raw)
    info, revision = law.get("law_info") or {}, law.get("revision_info") or {}
    root = law if law.get("law_full_text") is None else law["law_full_text"]
    number, title = info.get("law_num"), revision.get("law_title")
    head = (info.get("law_id"), _heading(_find(root, "LawNum")) if number is None else number, _heading(_find(root, "LawTitle")) if title is None else title)
    place = 0

    def walk(node: dict, chapter: str | None, section: str | None) -> Iterator[tuple]:
        nonlocal place
        for child in _children(node):
            if child.get("tag") == "Article":
                number = (child.get("attr") or {}).get("Num")
                named = next(iter(_children(child, "ArticleCaption")), None)
                caption = None if named is None else _text(named, False)
                if caption is not None:
                    caption = caption[caption[:1] in ("（", "(") :]
                    caption = caption[: len(caption) - (caption[-1:] in ("）", ")"))].strip(SPACE)
                label = _heading(next(iter(_children(child, "ArticleTitle")), None))
                place += 1
                for k, p in enumerate(_children(child, "Paragraph")):
                    text = _without_space(_text(p, True))
                    if text and number:
                        own = (p.get("attr") or {}).get("Num")
                        yield (*head, place, number, caption, label, chapter, section, k, "1" if own is None else str(own), text, True)
            else:
                tag = child.get("tag")
                title = _heading(next(iter(_children(child, f"{tag}Title")), None)) if tag in ("Chapter", "Section") else None
                yield from walk(child, title if tag == "Chapter" else chapter, title if tag == "Section" else section)

    main = _find(root, "MainProvision")
    if main:
        yield from walk(main, None, None)

    def articles(node: dict) -> int:
        return sum((c.get("tag") == "Article") + articles(c) for c in _children(node))

    def extra(node: dict) -> int:
        return sum(articles(c) if c.get("tag") == "SupplProvision" else extra(c) for c in _children(node))

    for _ in range(extra(root)):
        place += 1
        yield (*head, place, None, None, None, None, None, None, None, None, False)


@udtf(returnType=ROW)
class LawParagraphs:
    """SELECT * FROM files, LATERAL law_paragraphs(value)"""

    def eval(self, raw: str):
        if raw is not None:
            yield from paragraphs(raw)


def read_laws(spark: SparkSession, path: str) -> DataFrame:
    """All laws under ``path``: a row per paragraph, with the file's name, by which laws are ordered."""
    spark.udtf.register("law_paragraphs", LawParagraphs)
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    files.createOrReplaceTempView("_law_files")
    return spark.sql("SELECT file, p.* FROM _law_files, LATERAL law_paragraphs(value) p")


def latest_by_title(catalogue: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exact titles (title) to laws (title, law_id, promulgated): the latest of several, flagged; null where there is none."""
    order = Window.partitionBy("title").orderBy(F.desc("promulgated"), "law_id")
    best = catalogue.withColumn("_n", F.row_number().over(order)).withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("title"))).where("_n = 1")
    return wanted.join(best, "title", "left").select("title", "law_id", F.coalesce(F.col("_c") > 1, F.lit(False)).alias("ambiguous"))


def chunks(rows: DataFrame, granularity: str = "paragraph") -> DataFrame:
    """id, law_id, title, article, paragraph, caption, chapter, section, text, index_text of the main provisions; for ``article`` the paragraphs joined in order."""
    main = rows.where("in_main AND article IS NOT NULL AND length(text) > 0")
    if granularity == "article":
        parts = F.array_sort(F.collect_list(F.struct("paragraph_pos", "text")))
        main = main.groupBy("law_id", "title", "article_pos", "article", "label", "caption", "chapter", "section").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text")).withColumn("paragraph", F.lit("0"))
    chunk_id = F.concat_ws("", "law_id", F.lit("#"), "article", F.lit("-"), "paragraph")
    return main.select(chunk_id.alias("id"), "law_id", "title", "article", "paragraph", "label", "caption", "chapter", "section", "text", F.concat(F.when(F.col("caption") != "", F.concat("caption", F.lit("　"))).otherwise(""), F.col("text")).alias("index_text"))


def address(chunk_id: Column) -> Column:
    """(law_id, article, paragraph) of a chunk's id; an article may hold underscores, not hyphens."""
    law, rest = F.substring_index(chunk_id, "#", 1), F.substring_index(chunk_id, "#", -1)
    return F.struct(law.alias("law_id"), F.substring_index(rest, "-", 1).alias("article"), F.substring_index(rest, "-", -1).alias("paragraph"))


def generated(parts: DataFrame) -> DataFrame:
    """Statute-like chunks from the part table (p_partkey, p_name, p_type), for queries that need citations."""
    k = F.col("p_partkey")
    target = lambda by, add: F.concat(F.lit("第"), int_to_kanji((k * by + add) % 301 + 1), F.lit("条"))
    name = F.concat(F.translate(F.lower("p_name"), " #0123456789", "  零壱弐参四五六七八九"), F.lit("及び"), F.lower("p_type"))
    rare = lambda x: F.decode(F.unhex(F.hex((x % 6000 + 13312).cast("long"))), "UTF-16BE")  # noqa: E731  words of few chunks
    name = F.concat(name, F.lit("及び"), rare(k), rare(k + 2000), rare(k * 2), rare(k * 3))
    tail = F.concat(name, F.lit("に係る届出を、遅滞なく主務大臣に提出しなければならない。"))
    text = (
        F.when(k % 11 == 0, F.concat(F.lit("民法"), target(3, 1), F.lit("の規定は、"), tail))
        .when(k % 13 == 0, F.concat(*[F.concat(target(5, i), F.lit("、")) for i in range(5)], tail))
        .when(k % 17 == 0, F.concat(F.lit("前項の規定は、"), target(1, 7), F.lit("第二項"), F.lit("の場合について準用する。")))
        .when(k % 5 == 0, F.concat(target(7, 2), F.lit("の二第三項第一号の規定により、"), tail, F.lit("ただし、前条の規定は、この限りでない。")))
        .otherwise(F.concat(target(2, 9), F.lit("第一項の規定により、"), tail, F.lit("同条の規定は、適用しない。")))
    )
    law = F.concat(F.lit("L"), (k % 3).cast("string"))
    article = (F.floor(k / 3) % 331 + 1).cast("string")
    paragraph = (F.floor(k / 993) + 1).cast("string")
    return parts.select(F.concat_ws("", law, F.lit("#"), article, F.lit("-"), paragraph).alias("id"), law.alias("law_id"), article.alias("article"), paragraph.alias("paragraph"), k.alias("chunk_idx"), text.alias("text"))


def write_generated(parts: DataFrame, path: str, laws: int = 20) -> None:
    """Tag-tree files, one a law, from the part table, for queries that need files: captions, items, blank paragraphs, supplementary provisions, and laws that are the tree alone."""
    k = F.col("p_partkey")
    tree = lambda tag, *children, num=None: F.concat(F.lit(f'{{"tag": "{tag}", "attr": {{'), *([F.lit('"Num": "'), num, F.lit('"')] if num is not None else []), F.lit('}, "children": ['), *_between(children), F.lit("]}"))
    said = lambda c: F.concat(F.lit('"'), c if isinstance(c, Column) else F.lit(c), F.lit('"'))
    first = tree(
        "Paragraph", tree("ParagraphCaption", said("（見出し）")), tree("ParagraphNum", said("１")), tree("ParagraphSentence", tree("Sentence", said(F.concat(F.col("p_name"), F.lit("　は、"))))),
        tree("Item", tree("ItemTitle", said("一")), tree("ItemSentence", said(F.col("p_brand"))), tree("Subitem3", tree("Subitem3Title", said("（１）")), tree("Sentence", said(F.col("p_type"))))), num=F.lit("1"),
    )
    second = tree("Paragraph", tree("Sentence", said(F.when(k % 4 == 0, " 　 ").otherwise(F.col("p_brand")))), num=F.lit("2"))
    caption = F.when(k % 3 == 0, F.concat(tree("ArticleCaption", said(F.concat(F.lit("（"), F.col("p_type"), F.lit(" ）")))), F.lit(", "))).otherwise("")
    article = tree("Article", F.concat(caption, tree("ArticleTitle", said("第何条"))), first, second, num=F.floor(k / laws).cast("string"))
    rows = parts.select((k % laws).alias("law"), F.struct(k.alias("k"), article.alias("j")).alias("a"))
    # a law is one file, so one row
    whole = rows.groupBy("law").agg(F.array_join(F.transform(F.array_sort(F.collect_list("a")), lambda x: x["j"]), ", ").alias("articles"))
    law = F.col("law").cast("string")
    extra = F.when(F.col("law") % 3 == 0, F.concat(F.lit(", "), tree("SupplProvision", tree("Article", tree("Paragraph", said("附則"))), tree("Article", said("x"))))).otherwise("")
    body = tree("LawBody", tree("LawTitle", said(F.concat(F.lit(" 題"), law))), F.concat(tree("MainProvision", tree("Chapter", tree("ChapterTitle", said("第一章　総則 ")), F.col("articles"))), extra))
    full = tree("Law", tree("LawNum", said(F.concat(F.lit("番号"), law))), body)
    wrapped = F.concat(F.lit('{"law_info": {"law_id": "L'), law, F.lit('", "law_num": "N'), law, F.lit('"}, "revision_info": {"law_title": "T'), law, F.lit('"}, "law_full_text": '), full, F.lit("}"))
    whole.select("law", F.when(F.col("law") % 5 == 0, full).otherwise(wrapped).alias("value")).repartition(laws, "law").write.partitionBy("law").text(path)


def _between(children: tuple) -> list:
    out = []
    for c in children:
        out += [F.lit(", ")] * bool(out) + [c]
    return out
