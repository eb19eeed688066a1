"""Page profiles, routing to readers, and summaries of what they made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def columns_aligned(x: Column, gap: float = 20.0, blocks: int = 4, least: int = 2) -> Column:
    """Whether left edges form two columns or more of two blocks each: sorted, cut where the step to the next is wide."""
    ordered = F.array_sort(x)
    start = F.struct(F.lit(0).alias("columns"), F.lit(0).alias("size"), F.lit(None).cast("double").alias("last"))
    full = lambda s: s["columns"] + F.when(s["size"] >= least, 1).otherwise(0)

    def step(s: Column, v: Column) -> Column:
        near = v - s["last"] < gap
        return F.struct(F.when(near, s["columns"]).otherwise(full(s)).alias("columns"), F.when(near, s["size"] + 1).otherwise(1).alias("size"), v.alias("last"))

    return (F.size(x) >= blocks) & (F.aggregate(ordered, start, step, full) >= 2)


def significant_image(images: Column, width: Column, height: Column, share: float = 0.05) -> Column:
    """Whether an image covers that share of the page; unknown sizes count as one that does."""
    return F.coalesce(F.exists(images, lambda i: F.abs(i["w"] * i["h"]) >= share * width * height), F.lit(True))


def page_class(length: Column, images: Column, tables: Column, captions: Column, least: int = 150, most: int = 600) -> Column:
    return F.when(length < least, "flattened").when(tables, "structured_text").when(images | (captions & (length < most)), "text_with_images").otherwise("pure_text")


def profiles(pages: DataFrame, least: int = 150, most: int = 600) -> DataFrame:
    """Pages (text, images, block_x, page_w, page_h) with their profile and class."""
    out = pages.withColumn("text_length", F.length(F.trim("text"))).withColumn("has_images", significant_image(F.col("images"), F.col("page_w"), F.col("page_h")))
    out = out.withColumn("has_tables", columns_aligned(F.col("block_x"))).withColumn("has_captions", text.has_caption(F.col("text")))
    return out.withColumn("page_class", page_class(F.col("text_length"), F.col("has_images"), F.col("has_tables"), F.col("has_captions"), least, most))


def largest_images(images: DataFrame, most: int = 4) -> DataFrame:
    """The largest images (doc_id, page, xref, w, h) of each page."""
    order = Window.partitionBy("doc_id", "page").orderBy(F.desc(F.abs(F.col("w") * F.col("h"))), "xref")
    return images.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def downscale(width: Column, height: Column, most: int = 2048) -> Column:
    return F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))


Reader = Callable[[bytes], str]


def routed(pages: DataFrame, ocr: Reader, vision: Reader, least_yield: int = 50) -> DataFrame:
    """Text that readers make of profiled pages (doc_id, page, page_class, image); pure text pages reach no reader.

    Structured pages go to OCR, pages with images to vision, flattened ones to OCR and, if it yields little, to vision; if
    that fails, what OCR gave is kept.
    """

    def call(reader: Reader, image: bytes) -> str:
        try:
            return reader(image).strip()
        except Exception:  # a page that a model can't read is left out, the others go on
            return ""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                model = "vision" if r.page_class == "text_with_images" else "ocr"
                got = call(vision if model == "vision" else ocr, r.image)
                if r.page_class == "flattened" and len(got) < least_yield and (other := call(vision, r.image)):
                    model, got = "vision", other
                if got:
                    rows.append((r.doc_id, r.page, r.page_class, model, got))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "page_class", "model", "text"])

    kind = pages.schema["doc_id"].dataType.simpleString()
    needed = pages.filter("page_class <> 'pure_text'").select("doc_id", "page", "page_class", "image")
    return needed.mapInPandas(read, f"doc_id {kind}, page int, page_class string, model string, text string")


def vision_summary(chunks: DataFrame) -> DataFrame:
    """For each document its pages by model and the details of each page."""
    detail = F.array_sort(F.collect_list(F.struct("page", "model", "page_class", F.length("text").alias("char_count"))))
    by = lambda m: F.count_distinct(F.when(F.col("model") == m, F.col("page"))).alias(f"{m}_pages")
    return chunks.groupBy("doc_id").agg(F.count_distinct("page").alias("pages_analyzed"), by("ocr"), by("vision"), F.sum(F.length("text")).alias("char_count"), detail.alias("page_details"))


def page_ranges(pages: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """For each key its distinct pages as ranges: ``1-3, 5``. Consecutive pages are islands."""
    rows = pages.select(*keys, F.col(page).cast("long").alias("_p")).distinct()
    rows = rows.withColumn("_i", F.col("_p") - F.row_number().over(Window.partitionBy(*keys).orderBy("_p")))
    runs = rows.groupBy(*keys, "_i").agg(F.min("_p").alias("lo"), F.max("_p").alias("hi"))
    one = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    parts = F.array_sort(F.collect_list(F.struct("lo", one.alias("s"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["s"]), ", ").alias("ranges"))


def checks_by_status(checks: DataFrame) -> DataFrame:
    """One row of counts of (status, fixable)."""
    return checks.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "warn", "skip")), F.count_if(F.col("fixable")).alias("fixable"))


def page_file(stem: Column, page: Column) -> Column:
    return F.format_string("cache/%s/page_%04d.png", stem, page)
