"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from quillon.llm.chat import OP2_SQL, op2_chat
from quillon.llm.decontamination import op5_decontamination
from quillon.llm.html_extraction import op10_html_extraction
from quillon.llm.licenses import op4_license_scan
from quillon.llm.merkle import OP11_SQL, op11_merkle_manifest
from quillon.llm.mixing import op7_mixing
from quillon.llm.periodic_runs import op12_periodic_runs
from quillon.llm.quality_gam import op8_quality_classifier
from quillon.llm.quality_rules import op9_quality_rules
from quillon.llm.repeated_passages import OP13_SQL, op13_repeated_passages
from quillon.llm.sharding import op1_sharding
from quillon.llm.simhash import op6_simhash
from quillon.llm.warc import OP3_SQL, op3_warc

_ALL = (
    op1_sharding, op2_chat, op3_warc, op4_license_scan, op5_decontamination, op6_simhash, op7_mixing, op8_quality_classifier, op9_quality_rules, op10_html_extraction,
    op11_merkle_manifest, op12_periodic_runs, op13_repeated_passages,
)
QUERIES = {f.__name__: f for f in _ALL}
#: Where SQL can't express the method, tests compare with brute force instead.
ORACLES = {"op2_chat": OP2_SQL, "op3_warc": OP3_SQL, "op11_merkle_manifest": OP11_SQL, "op13_repeated_passages": OP13_SQL}
