"""Sinks: JSON exports, learning rows, draw commands, and PDF files where a PDF library is installed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "book_id string, added bigint, failed bigint"


def export_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, in the order of pages, part after part."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def export_unmatched(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_commands(commands: DataFrame, path: str) -> DataFrame:
    """Draw commands as Parquet by book; returns how many each book got. A book without any gets no file."""
    commands.write.mode("overwrite").partitionBy("book_id").parquet(path)
    return commands.groupBy("book_id").agg(F.count("*").alias("added"))


def draw(commands: DataFrame, documents: DataFrame, folder: str) -> DataFrame:
    """Draw each book's commands into its PDF under ``folder`` (a path all executors share) and count them (needs PyMuPDF).

    ``documents`` have book_id and content. A book is drawn by one task; rows that fail are counted and passed over, and so
    are all rows of a book without a document.
    """

    def one(marks: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        if not len(marks) or not len(files):  # nothing to draw, or nothing to draw it in
            rows = [(b, 0, int(n)) for b, n in marks.groupby("book_id").size().items()]
            return pd.DataFrame(rows, columns=["book_id", "added", "failed"])
        import fitz

        book = marks["book_id"].iloc[0]
        added = failed = 0
        with fitz.open(stream=files["content"].iloc[0], filetype="pdf") as doc:
            outline = doc.get_toc()
            for r in marks.sort_values(["page", "ord"]).to_dict("records"):
                try:
                    if r["command"] == "bookmark":
                        outline.append([1, r["title"], int(r["outline_page"])])
                    elif r["command"] == "note":
                        doc[int(r["page"])].add_text_annot(fitz.Point(*r["point"]), r["content"])
                    else:
                        mark = doc[int(r["page"])].add_highlight_annot([fitz.Rect(q["x0"], q["y0"], q["x1"], q["y1"]) for q in r["rects"]])
                        mark.set_colors(stroke=list(r["color"]))
                        mark.set_info(title=r["title"], content=r["content"])
                        mark.update()
                    added += 1
                except (ValueError, RuntimeError, IndexError):
                    failed += 1
            if added:
                doc.set_toc(outline)
                doc.save(f"{folder}/{book.rsplit('/', 1)[-1].removesuffix('.pdf')}_annotated.pdf", garbage=4, deflate=True, clean=True)
        return pd.DataFrame([(book, added, failed)], columns=["book_id", "added", "failed"])

    # Cogrouped, so a document's bytes travel once, not with each of its marks.
    return commands.groupBy("book_id").cogroup(documents.select("book_id", "content").groupBy("book_id")).applyInPandas(one, RESULT)
