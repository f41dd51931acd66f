"""Corpus pipeline: quality rules, near-duplicates, personal data, mixing, and byte-level BPE, stage by stage.

The stages are those of ``plumbline.llm.stages``: each takes (spark, docs,
sf_dir) and returns a DataFrame that is written and read again for the next;
the first four return the columns of ``documents``, the last token ids.
"""

from plumbline.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
