"""Model calls that a caller hands in: embedding with a prefix and shortening, page vectors in batches, deadlines.

A model is given as `load`, which is called once a task and returns the function to call, so that weights are loaded
where they are used. Rows whose call fails keep their place with an `error`; a lost task is simply run again.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Vector = Sequence[float]
Embed = Callable[[str], Vector]
EmbedPages = Callable[[list[bytes]], Sequence[Sequence[Vector]]]

#: What goes before a text, the share of words that stays when it is too long, attempts after the first, and fewest words.
DOCUMENT, QUERY = "search_document: ", "search_query: "
SHARE, RETRIES, LEAST_WORDS = 0.75, 3, 10


class TooLong(Exception):
    """Raised by a model whose context a text exceeds."""


class Late(Exception):
    """A call that did not end in time."""


def lengths(words: int) -> Iterator[int]:
    """How many words to keep in each further attempt."""
    for _ in range(RETRIES):
        words = int(words * SHARE)
        if words < LEAST_WORDS:
            return
        yield words


def embed_one(embed: Embed, text: str, prefix: str = DOCUMENT) -> Vector:
    """The vector of a text, shortened until the model takes it; TooLong if it never does."""
    try:
        return embed(prefix + text)
    except TooLong:
        words = text.split()
    for n in lengths(len(words)):
        try:
            return embed(prefix + " ".join(words[:n]))
        except TooLong:
            continue
    raise TooLong(f"{len(words)} words do not fit")


def within(seconds: float | None, call: Callable[[threading.Event], object]) -> object:
    """call's result, or Late after so many seconds. The call is handed an event that is set then, and is waited for no longer."""
    cancelled, out = threading.Event(), {}
    if seconds is None:
        return call(cancelled)

    def work() -> None:
        try:
            out["value"] = call(cancelled)
        except BaseException as e:  # noqa: BLE001  handed on below
            out["error"] = e

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        cancelled.set()
        raise Late(f"more than {seconds:g} s")
    if "error" in out:
        raise out["error"]
    return out["value"]


def embedded(df: DataFrame, load: Callable[[], Embed], prefix: str = DOCUMENT, seconds: float | None = None, key: Sequence[str] = ("slug", "chunk_index")) -> DataFrame:
    """The key and `vector` of each row of (key, text), or null and an `error`. A null text is one."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = None
        for pdf in frames:
            embed = embed or load()
            vectors, errors = [], []
            for text in pdf["text"]:
                try:
                    if text is None:
                        raise ValueError("no text")
                    vectors.append([float(x) for x in within(seconds, lambda _, t=text: embed_one(embed, t, prefix))])
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a bad row is skipped, whatever the model's client raises
                    vectors.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf[list(key)].assign(vector=vectors, error=errors)

    return df.select(*key, "text").mapInPandas(run, f"{kinds}, vector array<float>, error string")


def page_vectors(pages: DataFrame, load: Callable[[], EmbedPages], batch: int = 4) -> DataFrame:
    """`vectors` of each page (slug, page_num, png), in batches of one document's pages; a batch that fails gives no rows.

    Where the model is not there (load raises ImportError) there are no vectors at all.
    """
    kind = pages.schema["slug"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = None
        for pdf in frames:
            try:
                embed = embed or load()
            except ImportError:
                return
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                try:
                    vectors = [[[float(x) for x in v] for v in page] for page in embed(list(part["png"]))]
                    yield part[["slug", "page_num"]].assign(vectors=vectors)
                except Exception:  # noqa: BLE001, S112
                    continue

    return pages.filter(F.col("png").isNotNull()).select("slug", "page_num", "png").mapInPandas(run, f"slug {kind}, page_num int, vectors array<array<float>>")
