"""The registered queries in SQL. Patterns and rule values are spelled out here on their own, so that they
check the library's."""

from __future__ import annotations

AUTH_LINES = r"""
ev AS (
  SELECT event_id, user_id, event_type, ts,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00 host' || (user_id % 7) || ' ' AS head,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS clock,
         '[' || (100 + event_id % 900) || ']' AS pid,
         'u' || user_id AS usr,
         '10.0.' || (user_id % 256) || '.' || (event_id % 256) AS ip,
         1024 + event_id % 50000 AS port
  FROM events
),
auth_lines AS (
  SELECT event_id, head || CASE event_id % 10
    WHEN 0 THEN 'sshd' || pid || ': Failed password for invalid user ' || usr || ' from ' || ip || ' port ' || port || ' ssh2'
    WHEN 1 THEN 'sshd' || pid || ': Failed password for ' || usr || ' from ' || ip || ' port ' || port || ' ssh2'
    WHEN 2 THEN 'sshd' || pid || ': Accepted password for ' || usr || ' from ' || ip || ' port ' || port || ' ssh2'
    WHEN 3 THEN 'sshd' || pid || ': pam_unix(sshd:session): session opened for user ' || usr || '(uid=1000) by root(uid=0)'
    WHEN 4 THEN 'sudo: pam_unix(sudo:session): session closed for user ' || usr
    WHEN 5 THEN 'sudo:  ' || usr || ' : TTY=pts/1 ; USER=root ; COMMAND=/usr/bin/ls'
    WHEN 6 THEN 'passwd' || pid || ': password updated successfully'
    WHEN 7 THEN 'sshd' || pid || ': Invalid user ' || usr || ' from ' || ip || ' port ' || port
    WHEN 8 THEN 'no header colon here'
    ELSE 'cron: job ' || event_type END AS line
  FROM ev
)"""

OTHER_LINES = r"""
words AS (
  SELECT *,
    ['systemd', 'rsyslogd', 'snapd', 'PackageKit', 'anacron', 'CRON', 'kernel', 'NetworkManager', 'dbus-daemon',
     'cron', 'osboxes'][event_id % 11 + 1] AS proc,
    ['usb', 'pci', 'cpu', 'memory', 'filesystem', 'ext4', 'data', 'nvme', 'audit', 'network', 'error', 'warning',
     'plain'][event_id % 13 + 1] AS low_word,
    ['install', 'upgrade', 'remove', 'configure', 'status', 'purge'][event_id % 6 + 1] AS act,
    ['auth.log', 'syslog.1', 'kern.log.1', 'dpkg.log', 'dmesg.1.gz', 'nginx.log', 'AUTH.LOG.2.GZ',
     'auth.log.1.gz-2026071921.backup', 'foo.txt', '.auth'][event_id % 10 + 1] AS filename
  FROM ev
),
kwords AS (
  SELECT *, CASE WHEN event_id % 2 = 0 THEN upper(low_word) ELSE low_word END AS word,
         '/var/log/host' || (user_id % 7) || '/' || filename AS file_path
  FROM words
),
syslog_lines AS (
  SELECT event_id, head || CASE WHEN event_id % 17 = 0 THEN 'no header colon here'
    ELSE proc || CASE WHEN event_id % 2 = 0 THEN pid ELSE '' END || ': unit ' || event_type || ' of ' || usr || ' done'
    END AS line
  FROM kwords
),
kern_lines AS (
  SELECT event_id, head || CASE WHEN event_id % 17 = 0 THEN 'no header colon here'
    ELSE 'kernel: ' || word || ' ' || event_type || ' ' || event_id || ': state changed' END AS line
  FROM kwords
),
dmesg_lines AS (
  SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '[Mon Jan 1 00:00:00 2024] usb ' || event_id
    ELSE '[' || lpad(CAST(event_id // 1000 AS VARCHAR), 5, ' ') || '.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0')
         || '000] ' || word || ' ' || event_type || ' ' || event_id END AS line
  FROM kwords
),
dpkg_lines AS (
  SELECT event_id, CASE WHEN event_id % 17 = 0 THEN clock || ' startup'
    ELSE clock || ' ' || act || '  pkg' || user_id || ':amd64'
         || CASE WHEN event_id % 7 = 0 THEN '' ELSE '   1.' || (event_id % 10) || '  2.0' END END AS line
  FROM kwords
),
mixed_lines AS (
  SELECT k.event_id, k.file_path, k.filename, d.log_type, CASE d.log_type
    WHEN 'auth' THEN a.line WHEN 'syslog' THEN s.line WHEN 'kern' THEN n.line WHEN 'dpkg' THEN p.line
    WHEN 'dmesg' THEN m.line ELSE 'GET /' || k.event_type || ' ' || k.event_id END AS line
  FROM kwords k
  JOIN (SELECT event_id, CASE
      WHEN starts_with(lower(filename), 'auth') THEN 'auth' WHEN starts_with(lower(filename), 'syslog') THEN 'syslog'
      WHEN starts_with(lower(filename), 'kern') THEN 'kern' WHEN starts_with(lower(filename), 'dpkg') THEN 'dpkg'
      WHEN starts_with(lower(filename), 'dmesg') THEN 'dmesg' WHEN starts_with(lower(filename), 'nginx') THEN 'nginx'
      ELSE 'unknown' END AS log_type FROM kwords) d USING (event_id)
  JOIN auth_lines a USING (event_id) JOIN syslog_lines s USING (event_id) JOIN kern_lines n USING (event_id)
  JOIN dpkg_lines p USING (event_id) JOIN dmesg_lines m USING (event_id)
)"""

# The patterns of lines and fields.
HEADER = r"'^(\S+)\s+(\S+)\s+([^\[:]+)(?:\[(\d+)\])?:\s*(.*)$'"
DPKG = r"'^(\S+\s+\S+)\s+(\w+)\s+(\S+)(?:\s+(.*))?$'"
DMESG = r"'^\[\s*([0-9.]+)\]\s+(.*)$'"
PATTERNS = {"auth": HEADER, "syslog": HEADER, "kern": HEADER, "dpkg": DPKG, "dmesg": DMESG}

NO_NETWORK = """
  CAST(NULL AS VARCHAR) AS "user", CAST(NULL AS VARCHAR) AS ip, CAST(NULL AS BIGINT) AS port,
  CAST(NULL AS VARCHAR) AS protocol"""
USER = r"""nullif(regexp_extract(message, 'for\s+(?:invalid\s+user\s+|user\s+)?([^\s(]+)', 1), '')"""
IP = r"""nullif(regexp_extract(message, 'from\s+(\d{1,3}(?:\.\d{1,3}){3})', 1), '')"""
PORT = r"""CAST(nullif(regexp_extract(message, 'port\s+(\d+)', 1), '') AS BIGINT)"""
PROTOCOL = r"""nullif(regexp_extract(message, '\b(ssh2|ssh)\b', 1), '')"""
NETWORK = f"""{USER} AS "user", {IP} AS ip, {PORT} AS port, {PROTOCOL} AS protocol"""


def header_fields(lines: str, extra: str = "") -> str:
    return f"""SELECT event_id{extra}, regexp_extract(line, {HEADER}, 1) AS timestamp,
  regexp_extract(line, {HEADER}, 2) AS hostname, regexp_extract(line, {HEADER}, 3) AS process,
  CAST(nullif(regexp_extract(line, {HEADER}, 4), '') AS BIGINT) AS pid, regexp_extract(line, {HEADER}, 5) AS message
  FROM {lines} WHERE regexp_matches(line, {HEADER})"""


def chosen(tests: list[str], values: list[str], other: str) -> str:
    branches = " ".join(f"WHEN {test} THEN '{value}'" for test, value in zip(tests, values))
    return f"CASE {branches} ELSE '{other}' END"


def classified(tests: list[str], rules: list[tuple[str, str, str]], other: tuple[str, str, str]) -> str:
    columns = [chosen(tests, [r[i] for r in rules], other[i]) for i in range(3)]
    return f"{columns[0]} AS event, {columns[1]} AS event_type, {columns[2]} AS severity"


def message_has(words: list[str]) -> list[str]:
    return [f"contains(lower(message), '{w}')" for w in words]


# The rules of each log type, in order of precedence.
AUTH_CLASS = classified(
    message_has(
        ["failed password", "accepted password", "invalid user", "session opened", "session closed",
         "password updated successfully"]
    ) + ["lower(process) = 'sudo'"],
    [
        ("Failed password", "AUTH_FAILURE", "HIGH"),
        ("Accepted password", "AUTH_SUCCESS", "LOW"),
        ("invalid user", "INVALID_USER", "HIGH"),
        ("session opened", "SESSION_OPEN", "INFO"),
        ("session closed", "SESSION_CLOSE", "INFO"),
        ("password updated successfully", "PASSWORD_CHANGE", "MEDIUM"),
        ("sudo command", "SUDO_COMMAND", "MEDIUM"),
    ],
    ("UNKNOWN", "UNKNOWN", "INFO"),
)
_PROCESSES = {
    "systemd": "SYSTEMD", "rsyslogd": "RSYSLOG", "snapd": "SNAP", "PackageKit": "PACKAGE", "anacron": "ANACRON",
    "CRON": "CRON", "kernel": "KERNEL", "NetworkManager": "NETWORK", "dbus-daemon": "DBUS",
}
SYSLOG_CLASS = classified(
    [f"process = '{p}'" for p in _PROCESSES],
    [(t, t, "INFO") for t in _PROCESSES.values()],
    ("SYSTEM_EVENT", "SYSTEM_EVENT", "INFO"),
)
_DEVICES = [
    ("usb", ("USB Device", "USB", "LOW")), ("pci", ("PCI Device", "PCI", "LOW")), ("cpu", ("CPU Event", "CPU", "INFO")),
    ("memory", ("Memory Event", "MEMORY", "MEDIUM")), ("filesystem", ("Filesystem Event", "FILESYSTEM", "MEDIUM")),
    ("ext4", ("Filesystem Event", "FILESYSTEM", "MEDIUM")), ("ata", ("Storage Event", "STORAGE", "MEDIUM")),
    ("nvme", ("Storage Event", "STORAGE", "MEDIUM")),
]
_KERN = _DEVICES + [
    ("audit", ("Audit Event", "AUDIT", "MEDIUM")), ("error", ("Kernel Error", "KERNEL_ERROR", "HIGH")),
    ("warning", ("Kernel Warning", "KERNEL_WARNING", "MEDIUM")),
]
_DMESG = _DEVICES + [
    ("network", ("Network Event", "NETWORK", "LOW")), ("error", ("Boot Error", "BOOT_ERROR", "HIGH")),
    ("warning", ("Boot Warning", "BOOT_WARNING", "MEDIUM")),
]
KERN_CLASS = classified(message_has([k for k, _ in _KERN]), [r for _, r in _KERN], ("Kernel Event", "KERNEL", "INFO"))
DMESG_CLASS = classified(message_has([k for k, _ in _DMESG]), [r for _, r in _DMESG], ("Boot Event", "BOOT", "INFO"))
DPKG_CLASS = classified(
    [f"lower(action) = '{a}'" for a in ("install", "upgrade", "remove", "configure")],
    [
        ("Package Installed", "PACKAGE_INSTALL", "LOW"), ("Package Upgraded", "PACKAGE_UPGRADE", "MEDIUM"),
        ("Package Removed", "PACKAGE_REMOVE", "HIGH"), ("Package Configured", "PACKAGE_CONFIGURE", "INFO"),
    ],
    ("Package Event", "PACKAGE", "INFO"),
)


def records(log_type: str, lines: str) -> str:
    """Records of one format from a relation ``event_id, line``."""
    if log_type == "dpkg":
        fields = f"""SELECT event_id, regexp_extract(line, {DPKG}, 1) AS timestamp, CAST(NULL AS VARCHAR) AS hostname,
          'dpkg' AS process, CAST(NULL AS BIGINT) AS pid, regexp_extract(line, {DPKG}, 2) AS action,
          trim(regexp_extract(line, {DPKG}, 2) || ' ' || regexp_extract(line, {DPKG}, 3) || ' '
            || regexp_extract(line, {DPKG}, 4)) AS message
          FROM {lines} WHERE regexp_matches(line, {DPKG})"""
    elif log_type == "dmesg":
        fields = f"""SELECT event_id, regexp_extract(line, {DMESG}, 1) AS timestamp, CAST(NULL AS VARCHAR) AS hostname,
          'kernel' AS process, CAST(NULL AS BIGINT) AS pid, regexp_extract(line, {DMESG}, 2) AS message
          FROM {lines} WHERE regexp_matches(line, {DMESG})"""
    else:
        fields = header_fields(lines)
    source = {"auth": "auth.log", "syslog": "syslog", "kern": "kern.log", "dpkg": "dpkg.log", "dmesg": "dmesg"}[log_type]
    classes = {"auth": AUTH_CLASS, "syslog": SYSLOG_CLASS, "kern": KERN_CLASS, "dpkg": DPKG_CLASS, "dmesg": DMESG_CLASS}
    network = NETWORK if log_type == "auth" else NO_NETWORK
    return f"""SELECT event_id, '{log_type}' AS log_type, '{source}' AS source_file, timestamp, hostname, process, pid,
      {classes[log_type]}, {network}, message FROM ({fields})"""


AUTH = f"WITH {AUTH_LINES}, auth_records AS ({records('auth', 'auth_lines')})"
ALL_LINES = f"WITH {AUTH_LINES}, {OTHER_LINES}"
MIXED = f"""{ALL_LINES}, mixed_records AS ({
    " UNION ALL ".join(
        records(t, f"(SELECT event_id, line FROM mixed_lines WHERE log_type = '{t}')") for t in PATTERNS)
})"""
MATCHED = "CASE log_type " + " ".join(f"WHEN '{t}' THEN regexp_matches(line, {p})" for t, p in PATTERNS.items()) + " ELSE false END"

BREAKS = r"'[\n\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def framed(relation: str, key: str, text: str) -> str:
    return f"""SELECT {key}, part, line FROM (
      SELECT {key}, part, regexp_replace(piece, '^{SPACES}+|{SPACES}+$', '', 'g') AS line FROM (
        SELECT {key}, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS part FROM (
          SELECT {key}, string_split_regex({text}, {BREAKS}) AS pieces FROM {relation})))
      WHERE line <> ''"""


def word_rows(relation: str, key: str, text: str) -> str:
    """Cleaned words with their places, and whether a token stands for them."""
    # The words that stay, and below the words a dictionary starts with.
    cleaned = rf"""regexp_replace(lower(coalesce({text}, '')), '{SPACES}+', ' ', 'g')"""
    return f"""SELECT {key}, pos, word, NOT (
        word IN ('for', 'from', 'the', 'and', 'to', 'of', 'on', 'in', 'a', 'an', 'is', 'was', 'at', 'by', 'with')
        OR regexp_full_match(word, '[0-9]+') OR contains(word, '.')) AS needs_token
      FROM (SELECT {key}, pos, regexp_replace(raw, '[^a-zA-Z0-9_\\-./:]', '', 'g') AS word FROM (
        SELECT {key}, unnest(raws) AS raw, generate_subscripts(raws, 1) AS pos FROM (
          SELECT {key}, string_split({cleaned}, ' ') AS raws FROM {relation})))
      WHERE word <> ''"""


def dictionary(relation: str, key: str, text: str) -> str:
    """CTEs ``words`` and ``dictionary`` of a relation."""
    return f"""words AS MATERIALIZED ({word_rows(relation, key, text)}),
    seeds AS (SELECT * FROM (VALUES ('failed', 'TK0001', 1::BIGINT), ('password', 'TK0002', 2), ('authentication', 'TK0003', 3),
      ('connection', 'TK0004', 4)) AS t(word, token, token_no)),
    firsts AS (SELECT word, min((({key})::HUGEINT << 40) + pos) AS first FROM words
      WHERE needs_token AND word NOT IN (SELECT word FROM seeds) GROUP BY word),
    dictionary AS MATERIALIZED (SELECT * FROM seeds UNION ALL
      SELECT word, 'TK' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END, n
      FROM (SELECT word, CAST(4 + row_number() OVER (ORDER BY first) AS BIGINT) AS n FROM firsts))"""


def normalized(key: str) -> str:
    return f"""SELECT w.{key}, string_agg(CASE WHEN w.needs_token THEN coalesce(d.token, w.word) ELSE w.word END, ' ' ORDER BY w.pos) AS text
      FROM words w LEFT JOIN dictionary d ON w.word = d.word GROUP BY w.{key}"""


DOCS = f"WITH {dictionary('documents', 'doc_id', 'text')}"

DICTIONARY_TEXTS = """texts AS (
  SELECT event_id, CASE event_id % 10
    WHEN 0 THEN '' WHEN 1 THEN '{bad' WHEN 2 THEN '{"word_to_token": {"' || event_type || '": "TK0001"}}'
    ELSE '{"counter": ' || (event_id % 5000) || ', "word_to_token": {"' || event_type || '": "TK0001", "u' || user_id
         || '": "TK0002"}}' END AS value
  FROM events)"""

RECORD_COLUMNS = [
    "log_type", "source_file", "timestamp", "hostname", "process", "pid", "severity", "event", "event_type", '"user"',
    "ip", "port", "protocol", "message",
]

LATIN = r"regexp_replace(text, '[^\x{00}-\x{ff}]', '?', 'g')"


def oracle_sql() -> dict[str, str]:
    sql = {
        "read_plain": f"{AUTH} SELECT event_id, line FROM auth_lines",
        "read_gzip": f"{AUTH} SELECT line, 'gzip' AS reader FROM auth_lines",
        "clean_utf8": f"""SELECT doc_id, regexp_replace({LATIN}, '[^\\x00-\\x7f]', '', 'g') AS text FROM documents""",
        "frame_lines": framed("documents", "doc_id", "text"),
        "parse_header": f"WITH {AUTH_LINES} {header_fields('auth_lines')}",
        "parse_auth": f"{AUTH} SELECT * FROM auth_records",
        "parse_all": f"{MIXED} SELECT * FROM mixed_records",
        "parse_rejects": f"""{ALL_LINES} SELECT event_id, log_type, line,
            CASE WHEN log_type IN ('auth', 'syslog', 'kern', 'dpkg', 'dmesg') THEN 'unmatched' ELSE 'unsupported' END AS reason
            FROM mixed_lines WHERE NOT {MATCHED}""",
        "process_files": "WITH " + AUTH_LINES + "," + OTHER_LINES + ", all_records AS ("
        + " UNION ALL ".join(records(t, f"{t}_lines") for t in PATTERNS)
        + ") SELECT * EXCLUDE (event_id) FROM all_records",
        "security_events": f"{AUTH} SELECT * FROM auth_records WHERE event_type <> 'UNKNOWN'",
        "network_events": f"{AUTH} SELECT * FROM auth_records WHERE ip IS NOT NULL",
        "user_events": f'{AUTH} SELECT * FROM auth_records WHERE "user" IS NOT NULL',
        "summary_counts": f"""{MIXED} SELECT log_type, dimension, value, count(*) AS n FROM (
            SELECT log_type, 'event_type' AS dimension, event_type AS value FROM mixed_records UNION ALL
            SELECT log_type, 'severity', severity FROM mixed_records UNION ALL
            SELECT log_type, 'process', process FROM mixed_records) GROUP BY ALL""",
        "record_counts": f"{MIXED} SELECT log_type, count(*) AS n_records FROM mixed_records GROUP BY log_type",
        "preview": f"{AUTH} SELECT * FROM auth_records ORDER BY event_id LIMIT 5",
        "chars_read": f"""{ALL_LINES} SELECT file_path, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars
            FROM mixed_lines GROUP BY file_path""",
        "detect_files": f"""{ALL_LINES} SELECT file_path AS path, filename, log_type,
            ends_with(lower(filename), '.gz') AS compressed,
            CAST(coalesce(nullif(regexp_extract(filename, '\\.(\\d+)(?:\\.gz)?$', 1), ''), '0') AS BIGINT) AS rotation,
            CASE WHEN ends_with(lower(filename), '.gz') THEN '.gz'
                 ELSE regexp_extract(filename, '^.+(\\.[^.]+)$', 1) END AS extension,
            CASE WHEN ends_with(lower(filename), '.gz') THEN 'gzip' ELSE 'file' END AS reader,
            '/var/log/' || split_part(file_path, '/', 4) AS directory,
            regexp_replace(filename, '(.)\\.[^.]+$', '\\1') AS stem,
            regexp_extract(filename, '^.+(\\.[^.]+)$', 1) AS suffix, count(*) AS n_lines
            FROM mixed_lines GROUP BY ALL""",
        "file_exists": f"""{ALL_LINES} SELECT path, path IN (SELECT file_path FROM mixed_lines WHERE log_type <> 'unknown') AS "exists"
            FROM (SELECT DISTINCT file_path AS path FROM mixed_lines)""",
        "run_report": f"""{ALL_LINES} SELECT path, log_type, reader, rotation, n_lines, n_records, CASE
              WHEN log_type NOT IN ('auth', 'syslog', 'kern', 'dpkg', 'dmesg') THEN 'unsupported'
              WHEN n_records = 0 THEN 'empty' ELSE 'ok' END AS status
            FROM (SELECT file_path AS path, log_type,
              CASE WHEN ends_with(lower(filename), '.gz') THEN 'gzip' ELSE 'file' END AS reader,
              CAST(coalesce(nullif(regexp_extract(filename, '\\.(\\d+)(?:\\.gz)?$', 1), ''), '0') AS BIGINT) AS rotation,
              count(*) AS n_lines, count(*) FILTER (WHERE {MATCHED}) AS n_records FROM mixed_lines GROUP BY ALL)
            UNION ALL SELECT file_path || '.missing', NULL, NULL, NULL, 0, 0, 'missing' FROM mixed_lines GROUP BY file_path""",
        "report_totals": f"""{ALL_LINES} SELECT
            count(DISTINCT file_path) FILTER (WHERE log_type IN ('auth', 'syslog', 'kern', 'dpkg', 'dmesg')) AS files_processed,
            count(*) FILTER (WHERE {MATCHED}) AS total_records FROM mixed_lines""",
        "clean_words": f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos, word, needs_token
            FROM ({word_rows('documents', 'doc_id', 'text')})""",
        "build_dictionary": f"{DOCS} SELECT word, token, token_no FROM dictionary",
        "dictionary_roundtrip": f"""{DOCS} SELECT word, token, token_no,
            (SELECT max(token_no) + 1 FROM dictionary) AS counter FROM dictionary""",
        "normalize_messages": f"""{DOCS}, tokens AS ({normalized('doc_id')})
            SELECT doc_id, coalesce(tokens.text, '') AS text FROM documents LEFT JOIN tokens USING (doc_id)""",
        "expand_messages": f"""{DOCS}, plain AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM words GROUP BY doc_id)
            SELECT doc_id, coalesce(plain.text, '') AS text FROM documents LEFT JOIN plain USING (doc_id)""",
        "build_dictionary_lines": f"""{AUTH}, {dictionary('auth_records', 'event_id', 'message')}
            SELECT word, token, token_no FROM dictionary""",
        "normalize_records": f"""{AUTH}, {dictionary('auth_records', 'event_id', 'message')}, tokens AS ({normalized('event_id')})
            SELECT r.* REPLACE (coalesce(tokens.text, '') AS message) FROM auth_records r LEFT JOIN tokens USING (event_id)""",
        "dictionary_load": f"""WITH {DICTIONARY_TEXTS}, good AS (
              SELECT event_id, value FROM texts WHERE event_id % 10 <> 3 AND json_valid(value)),
            entries AS (SELECT event_id, coalesce(CAST(json_extract(value, '$.counter') AS BIGINT), 1) AS counter,
              json_extract(value, '$.word_to_token') AS entry_map, unnest(json_keys(value, '$.word_to_token')) AS word FROM good)
            SELECT event_id, counter, word, json_extract_string(entry_map, '$."' || word || '"') AS token FROM entries
            UNION ALL SELECT event_id, 1, 'w', 'TK0003' FROM events WHERE event_id % 10 = 3
            UNION ALL SELECT event_id, 1, event_type, 'TK0002' FROM events WHERE event_id % 10 = 3""",
        "dictionary_stats": f"""{DOCS}, raw_words AS (
              SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents)
            SELECT 'size' AS stat, count(*) AS n FROM dictionary UNION ALL
            SELECT 'counter', max(token_no) + 1 FROM dictionary UNION ALL
            SELECT 'contained', count(*) FROM raw_words WHERE word IN (SELECT word FROM dictionary) UNION ALL
            SELECT 'cleared_size', 0 UNION ALL SELECT 'cleared_counter', 1""",
        "json_roundtrip": f"{AUTH} SELECT * FROM auth_records",
        "csv_roundtrip": AUTH + " SELECT "
        + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in ["event_id", *RECORD_COLUMNS])
        + " FROM auth_records",
        "sink_counts": f"""{AUTH} SELECT sink, stage, CASE stage WHEN 'written' THEN (SELECT count(*) FROM auth_records) ELSE 0 END AS n
            FROM (VALUES ('json', 'written'), ('csv', 'written'), ('json', 'cleared'), ('csv', 'cleared')) AS t(sink, stage)""",
        "table_append": f"""{ALL_LINES}, a AS ({records('auth', 'auth_lines')}), k AS ({records('kern', 'kern_lines')}),
            stored AS (SELECT row_number() OVER (ORDER BY event_id) AS id, * FROM a UNION ALL
              SELECT (SELECT count(*) FROM a) + row_number() OVER (ORDER BY event_id), * FROM k)
            SELECT id, log_type, event_id, event_type, "user", port, message FROM stored""",
        "table_clear": f"""{ALL_LINES}, a AS ({records('auth', 'auth_lines')}), k AS ({records('kern', 'kern_lines')})
            SELECT 'row' AS step, event_id AS n, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY event_id) AS id FROM k
            UNION ALL SELECT 'append', count(*), count(*) FROM a UNION ALL SELECT 'clear', 0, count(*) FROM a
            UNION ALL SELECT 'append again', (SELECT count(*) FROM k), count(*) + (SELECT count(*) FROM k) FROM a""",
        "catalog_files": """SELECT stem || suffix AS filename, log_type, compressed, k AS rotation, extension,
              CASE WHEN compressed THEN 'gzip' ELSE 'file' END AS reader, stem, suffix
            FROM (SELECT k, log_type, compressed, CASE WHEN compressed THEN log_type || '.' || k ELSE log_type || '.log' END AS stem,
                CASE WHEN compressed THEN '.gz' ELSE '.' || k END AS suffix, suffix AS extension
              FROM (SELECT DISTINCT event_id % 4 AS k FROM events),
                (VALUES ('auth', false), ('nginx', false), ('dmesg', true), ('syslog', true)) AS t(log_type, compressed))""",
        "run_report_files": f"""{ALL_LINES}, a AS ({records('auth', 'auth_lines')}), d AS ({records('dmesg', 'dmesg_lines')}),
            n AS (SELECT k, count(*) AS n_lines, (SELECT count(*) FROM a WHERE event_id % 4 = k) AS n_auth,
              (SELECT count(*) FROM d WHERE event_id % 4 = k) AS n_dmesg FROM (SELECT event_id % 4 AS k FROM auth_lines) GROUP BY k)
            SELECT 'auth.log.' || k AS filename, 'auth' AS log_type, 'file' AS reader, k AS rotation, n_lines, n_auth AS n_records,
              'ok' AS status FROM n
            UNION ALL SELECT 'dmesg.' || k || '.gz', 'dmesg', 'gzip', k, n_lines, n_dmesg, 'ok' FROM n
            UNION ALL SELECT 'nginx.log.' || k, 'nginx', 'file', k, n_lines, 0, 'unsupported' FROM n
            UNION ALL SELECT 'syslog.' || k || '.gz', 'syslog', 'gzip', k, NULL, NULL, 'failed' FROM n
            UNION ALL SELECT 'absent.log', NULL, NULL, NULL, 0, 0, 'missing'""",
        "tail_first": f"{AUTH} SELECT line FROM auth_lines",
        "tail_append": f"{AUTH} SELECT event_id % 2 AS round, line FROM auth_lines",
        "tail_bounded": f"{AUTH} SELECT line, TRUE AS fits FROM auth_lines",
        "stream_counts": f"""{AUTH} SELECT dimension, value, count(*) AS n FROM (
            SELECT 'event_type' AS dimension, event_type AS value FROM auth_records UNION ALL
            SELECT 'severity', severity FROM auth_records UNION ALL
            SELECT 'process', process FROM auth_records) GROUP BY ALL""",
        "tail_rotation": f"""{AUTH} SELECT CAST(LEAST(event_id % 5, 3) AS BIGINT) AS round,
            CAST(CASE event_id % 5 WHEN 4 THEN 1 ELSE 0 END AS INTEGER) AS segment, line FROM auth_lines""",
    }
    sql["stream_normalize"] = f"SELECT doc_id, text FROM ({sql['normalize_messages']})"
    for name in ("normalize_messages", "expand_messages"):
        sql[f"{name}_large"] = sql[name]
    for log_type in ("syslog", "kern", "dpkg", "dmesg"):
        sql[f"parse_{log_type}"] = f"{ALL_LINES} {records(log_type, log_type + '_lines')}"
    for log_type in PATTERNS:
        prefix = AUTH if log_type == "auth" else f"{ALL_LINES}, {log_type}_records AS ({records(log_type, log_type + '_lines')})"
        sql[f"classify_{log_type}"] = f"{prefix} SELECT event_id, event, event_type, severity FROM {log_type}_records"
    for field, expression in (("user", USER), ("ip", IP), ("port", PORT), ("protocol", PROTOCOL)):
        sql[f"extract_{field}"] = f"""WITH {AUTH_LINES}, m AS ({header_fields('auth_lines')})
            SELECT event_id, {expression} AS "{field}" FROM m"""
    return sql
