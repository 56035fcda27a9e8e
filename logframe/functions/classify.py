"""Ordered rule tables: the first rule that hits names the event, its type and its severity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Rule:
    """``match`` says how ``key`` is compared with ``field``: contains, equals or equals_lower."""

    key: str
    event: str
    event_type: str
    severity: str
    field: str = "message"
    match: str = "contains"

    def test(self, fields: dict[str, Column]) -> Column:
        """``fields`` has each field under its name and its lower-case form under ``<name>_lower``."""
        if self.match == "contains":
            return F.contains(fields[f"{self.field}_lower"], F.lit(self.key.lower()))
        if self.match == "equals_lower":
            return fields[f"{self.field}_lower"] == self.key
        if self.match == "equals":
            return fields[self.field] == self.key
        raise ValueError(f"unknown match kind: {self.match!r}")


@dataclass(frozen=True)
class RuleTable:
    rules: tuple[Rule, ...]
    fallback: tuple[str, str, str]

    def number(self, fields: dict[str, Column]) -> Column:
        """1-based number of the first rule that hits; the fallback comes last."""
        number = F.lit(len(self.rules) + 1)
        for position in range(len(self.rules), 0, -1):
            number = F.when(self.rules[position - 1].test(fields), position).otherwise(number)
        return number

    def values(self, attribute: int) -> list[str]:
        return [(r.event, r.event_type, r.severity)[attribute] for r in self.rules] + [self.fallback[attribute]]


# Keyword or name, event, event type, severity; in order of precedence.
AUTH_RULES = RuleTable(
    (
        Rule("Failed password", "Failed password", "AUTH_FAILURE", "HIGH"),
        Rule("Accepted password", "Accepted password", "AUTH_SUCCESS", "LOW"),
        Rule("invalid user", "invalid user", "INVALID_USER", "HIGH"),
        Rule("session opened", "session opened", "SESSION_OPEN", "INFO"),
        Rule("session closed", "session closed", "SESSION_CLOSE", "INFO"),
        Rule("password updated successfully", "password updated successfully", "PASSWORD_CHANGE", "MEDIUM"),
        Rule("sudo", "sudo command", "SUDO_COMMAND", "MEDIUM", "process", "equals_lower"),
    ),
    ("UNKNOWN", "UNKNOWN", "INFO"),
)

SYSLOG_RULES = RuleTable(
    tuple(
        Rule(process, event_type, event_type, "INFO", "process", "equals")
        for process, event_type in (
            ("systemd", "SYSTEMD"),
            ("rsyslogd", "RSYSLOG"),
            ("snapd", "SNAP"),
            ("PackageKit", "PACKAGE"),
            ("anacron", "ANACRON"),
            ("CRON", "CRON"),
            ("kernel", "KERNEL"),
            ("NetworkManager", "NETWORK"),
            ("dbus-daemon", "DBUS"),
        )
    ),
    ("SYSTEM_EVENT", "SYSTEM_EVENT", "INFO"),
)

_DEVICE_RULES = (
    Rule("usb", "USB Device", "USB", "LOW"),
    Rule("pci", "PCI Device", "PCI", "LOW"),
    Rule("cpu", "CPU Event", "CPU", "INFO"),
    Rule("memory", "Memory Event", "MEMORY", "MEDIUM"),
    Rule("filesystem", "Filesystem Event", "FILESYSTEM", "MEDIUM"),
    Rule("ext4", "Filesystem Event", "FILESYSTEM", "MEDIUM"),
    Rule("ata", "Storage Event", "STORAGE", "MEDIUM"),
    Rule("nvme", "Storage Event", "STORAGE", "MEDIUM"),
)

KERN_RULES = RuleTable(
    _DEVICE_RULES
    + (
        Rule("audit", "Audit Event", "AUDIT", "MEDIUM"),
        Rule("error", "Kernel Error", "KERNEL_ERROR", "HIGH"),
        Rule("warning", "Kernel Warning", "KERNEL_WARNING", "MEDIUM"),
    ),
    ("Kernel Event", "KERNEL", "INFO"),
)

DMESG_RULES = RuleTable(
    _DEVICE_RULES
    + (
        Rule("network", "Network Event", "NETWORK", "LOW"),
        Rule("error", "Boot Error", "BOOT_ERROR", "HIGH"),
        Rule("warning", "Boot Warning", "BOOT_WARNING", "MEDIUM"),
    ),
    ("Boot Event", "BOOT", "INFO"),
)

DPKG_RULES = RuleTable(
    (
        Rule("install", "Package Installed", "PACKAGE_INSTALL", "LOW", "action", "equals_lower"),
        Rule("upgrade", "Package Upgraded", "PACKAGE_UPGRADE", "MEDIUM", "action", "equals_lower"),
        Rule("remove", "Package Removed", "PACKAGE_REMOVE", "HIGH", "action", "equals_lower"),
        Rule("configure", "Package Configured", "PACKAGE_CONFIGURE", "INFO", "action", "equals_lower"),
    ),
    ("Package Event", "PACKAGE", "INFO"),
)
