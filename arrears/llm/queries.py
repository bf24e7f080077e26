"""The queries of this subpackage and, where SQL can express them, their oracles."""

import corpus_pipeline
from arrears.llm import q01, q02, q03, q04, q05, q06, q07, q08, q09, q10

QUERIES = {
    "op1_langid": q01.op1_langid,
    "op2_simhash": q02.op2_simhash,
    "op3_warc": q03.op3_warc,
    "op4_licenses": q04.op4_licenses,
    "op5_vectors": q05.op5_vectors,
    "op6_linededup": q06.op6_linededup,
    "op7_packing": q07.op7_packing,
    "op8_pii": q08.op8_pii,
    "op9_trainorder": q09.op9_trainorder,
    "op10_decontam": q10.op10_decontam,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op3_warc": q03.SQL,
    "op4_licenses": q04.SQL,
    "op5_vectors": q05.SQL,
    "op6_linededup": q06.SQL,
    "op10_decontam": q10.SQL,
}
