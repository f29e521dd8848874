"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from docjobs.llm import centroids, decontam, exact_dedup, html_extract, merkle, minhash, packing, secrets, simhash, token_files, toxicity, url_filter, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_simhash": simhash.op2_simhash,
    "op3_decontaminate": decontam.op3_decontaminate,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_warc": warc.op5_warc,
    "op6_secrets": secrets.op6_secrets,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_token_files": token_files.op10_token_files,
    "op11_minhash": minhash.op11_minhash,
    "op12_centroids": centroids.op12_centroids,
    "op13_merkle": merkle.op13_merkle,
}
ORACLE_SQL = {
    "op1_packing": packing.ORACLE_SQL,
    "op3_decontaminate": decontam.ORACLE_SQL,
    "op5_warc": warc.ORACLE_SQL,
    "op8_url_filter": url_filter.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op12_centroids": centroids.ORACLE_SQL,
    "op13_merkle": merkle.ORACLE_SQL,
}
