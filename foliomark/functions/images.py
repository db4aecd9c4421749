"""Names, links and inline forms of page images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_name(page_no: Column, img_no: Column) -> Column:
    """Always ``.png``, whatever the bytes are; ``img_no`` counts per page from 1."""
    return F.format_string("page_%d_img_%d.png", page_no, img_no)


def data_uri(content: Column) -> Column:
    """Inline form; some sessions break base64 into lines, a link must not be broken."""
    encoded = F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))
    return F.concat(F.lit("data:image/png;base64,"), encoded)


def image_folder(image_dir: str, stem: Column) -> Column:
    """Folder of a document's images, relative to its output file."""
    return F.concat(F.lit(f"{image_dir.rstrip('/')}/"), stem)


def link_item(
    page_no: Column, img_no: Column, folder: Column, content: Column | None = None
) -> Column:
    """Link line of one image; with ``content`` the image is embedded instead."""
    name = image_name(page_no, img_no)
    target = F.concat(folder, F.lit("/"), name) if content is None else data_uri(content)
    return F.concat(F.lit("\n!["), name, F.lit("]("), target, F.lit(")\n"))
