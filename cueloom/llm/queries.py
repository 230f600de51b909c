"""Name -> query of each operator, and the SQL of those that SQL can express."""

from cueloom.llm.decontaminate import op5_decontamination
from cueloom.llm.embedding_dedup import OP10_SQL, op10_embedding_dedup
from cueloom.llm.fertility import op11_quality_rules
from cueloom.llm.language_id import op4_language_id
from cueloom.llm.license_scan import op1_license_scan, op1_sql
from cueloom.llm.packing import op7_packing
from cueloom.llm.quality import op3_quality
from cueloom.llm.ranked_search import OP13_SQL, op13_ranked_search
from cueloom.llm.simhash import op2_simhash
from cueloom.llm.substring import OP9_SQL, op9_substring_dedup
from cueloom.llm.suffix_dedup import OP8_SQL, op8_suffix_dedup
from cueloom.llm.vector_codes import op12_sql, op12_vector_codes
from cueloom.llm.warc import OP6_SQL, op6_warc

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_simhash, op3_quality, op4_language_id, op5_decontamination, op6_warc, op7_packing, op8_suffix_dedup, op9_substring_dedup, op10_embedding_dedup, op11_quality_rules, op12_vector_codes, op13_ranked_search)}
ORACLE_SQL = {"op1_license_scan": op1_sql(), "op6_warc": OP6_SQL, "op8_suffix_dedup": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op10_embedding_dedup": OP10_SQL, "op12_vector_codes": op12_sql(), "op13_ranked_search": OP13_SQL}
