"""op4: main text of all pages."""

from __future__ import annotations

from tickloom.llm.common import read
from tickloom.llm.html import extract_main_text


def op4_html_extraction(spark, sf_dir):
    return extract_main_text(read(spark, sf_dir, "pages"))
