"""Linux log analytics as Spark DataFrame operators."""

from .operators.dictionary import (
    Dictionary,
    build_dictionary,
    clear_dictionary,
    contains_words,
    drop_old_versions,
    import_dictionary,
    load_dictionary,
    parse_dictionary_json,
    save_dictionary,
    seed_dictionary,
)
from .operators.frame import frame_lines
from .operators.normalize import expand_messages, normalize, normalize_messages
from .operators.numbering import number_rows
from .operators.parse import (
    FORMATS,
    LogFormat,
    parse,
    parse_all,
    parse_auth,
    parse_dmesg,
    parse_dpkg,
    parse_header,
    parse_kern,
    parse_rejects,
    parse_syslog,
)
from .operators.stats import (
    chars_read,
    network_events,
    preview,
    record_counts,
    security_events,
    summary_counts,
    user_events,
)
from .plans.jobs import UnsupportedLogType, process_logs, report_totals, run_report
from .session import build_session
from .sinks.files import clear_csv, clear_json, read_csv, read_json, write_csv, write_json
from .sinks.keyed_table import KeyedTable
from .sources.files import broken_files, catalog_files, catalog_paths, mark_existing
from .sources.lines import read_lines
from .sources.spread import spread
from .streaming.counts import read_counts, write_counts
from .streaming.dictionary import normalize_stream, stream_dictionary, stream_messages
from .streaming.tail import SCHEMA as TAIL_SCHEMA, register_tail_source, tail_logs

__all__ = [name for name in dir() if not name.startswith("_")]
