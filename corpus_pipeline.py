"""The corpus pipeline: five stages over documents, each written and read again before the next."""

from kernelweave.llm.pipeline import ORACLE_SQL, STAGES, bpe_ids, language_id, mix_sources, near_dedup, run, substring_dedup

__all__ = ["ORACLE_SQL", "STAGES", "bpe_ids", "language_id", "mix_sources", "near_dedup", "run", "substring_dedup"]
