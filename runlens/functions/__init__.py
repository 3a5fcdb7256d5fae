from runlens.functions.identity import experiment_id, java_hash, run_id, wrap32
from runlens.functions.ranhash import DEFAULT_SEED, with_bounded_int, with_uniform
from runlens.functions.text import format_run_name, parse_run_name, substitute, unknown_keys, word_tokens
from runlens.functions.timestamps import dstat_epoch, format_millis, log_timestamp
from runlens.functions.versions import version_key, version_numbers, version_prefixes, version_suffix

__all__ = [
    "DEFAULT_SEED", "dstat_epoch", "experiment_id", "format_millis", "format_run_name",
    "java_hash", "log_timestamp", "parse_run_name", "run_id", "substitute", "unknown_keys", "version_key", "version_numbers",
    "version_prefixes", "version_suffix", "with_bounded_int", "with_uniform", "word_tokens", "wrap32",
]
