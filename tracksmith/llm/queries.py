"""The corpus operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from tracksmith.llm.embeddings import op1_embeddings
from tracksmith.llm.exact import OP7_SQL, op7_exact_dedup
from tracksmith.llm.katz import op9_katz
from tracksmith.llm.licenses import op8_licenses
from tracksmith.llm.mixing import op6_source_mix
from tracksmith.llm.packing import op10_packing
from tracksmith.llm.quality import op4_quality
from tracksmith.llm.simhash import op2_simhash
from tracksmith.llm.urlfilter import OP5_SQL, op5_url_filter
from tracksmith.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_embeddings": op1_embeddings,
    "op2_simhash": op2_simhash,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_url_filter": op5_url_filter,
    "op6_source_mix": op6_source_mix,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_licenses": op8_licenses,
    "op9_katz": op9_katz,
    "op10_packing": op10_packing,
}

ORACLE_SQL = {"op3_warc": OP3_SQL, "op5_url_filter": OP5_SQL, "op7_exact_dedup": OP7_SQL}
