"""The subpackage's queries and oracle SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.llm.ann import op2_nearest
from tarn.llm.decontam import op8_decontam
from tarn.llm.fixity import OP9_SQL, op9_fixity
from tarn.llm.jaccard import op7_jaccard
from tarn.llm.oracles import OP7_SQL
from tarn.llm.packing import op1_packing
from tarn.llm.pii import op6_personal
from tarn.llm.secret_scan import op5_secrets
from tarn.llm.sharding import op10_sharding
from tarn.llm.suffix_dedup import op4_suffixes
from tarn.llm.toxicity import op3_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {"op1_packing": op1_packing, "op2_nearest": op2_nearest, "op3_toxicity": op3_toxicity, "op4_suffixes": op4_suffixes, "op5_secrets": op5_secrets, "op6_personal": op6_personal, "op7_jaccard": op7_jaccard, "op8_decontam": op8_decontam, "op9_fixity": op9_fixity, "op10_sharding": op10_sharding}


def oracle_sql() -> dict[str, str]:
    """Only where plain SQL on whole tables expresses the rows."""
    return {"op7_jaccard": OP7_SQL, "op9_fixity": OP9_SQL}
