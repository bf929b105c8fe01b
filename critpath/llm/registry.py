"""The queries of this subpackage, for the entry module at the top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op8_decontaminate
from .html_extract import op5_html
from .images import op9_images
from .langid import op7_langid
from .license_scan import op4_licenses
from .lm_score import op3_ppm
from .mixing import op1_mixing
from .oracles import ORACLE_SQL  # noqa: F401
from .simhash import op10_simhash
from .toxicity import op6_toxicity
from .url_filter import op2_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_urls": op2_urls,
    "op3_ppm": op3_ppm,
    "op4_licenses": op4_licenses,
    "op5_html": op5_html,
    "op6_toxicity": op6_toxicity,
    "op7_langid": op7_langid,
    "op8_decontaminate": op8_decontaminate,
    "op9_images": op9_images,
    "op10_simhash": op10_simhash,
}
