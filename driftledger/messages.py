"""The words, statuses and messages that appear in results."""

APPLIED = "applied"
REVERTED = "reverted"
UP = "up"
DOWN = "down"

OK = "OK"
DRIFT = "DRIFT"

NOTE_BACKFILLED = "backfilled: applied before ledger existed"
NOTE_APPLIED = "applied via up/push"
NOTE_REVERTED = "reverted via down"
NOTE_SOFT_REVERTED = "soft-reverted via rollback"
NOTE_REPAIRED = "repaired"

EDITED = "migration file was edited after it was applied (content hash mismatch)"
MISSING_OBJECT = "%s.%s: claimed applied but missing"
LEFTOVER_OBJECT = "%s.%s: claimed reverted but still exists"
NO_SCRIPT = "version %d does not match any migration file in %s"
NO_DOWN_SCRIPT = "version %d does not have a matching .down.sql migration file in %s"

UNKNOWN_KIND = 'unknown object kind "%s"'

RULE_FILENAME = "invalid-filename-format"
RULE_VERSION = "invalid-version-number"
RULE_EMPTY = "empty-migration-file"
RULE_DUPLICATE = "duplicate-version-number"
LINT_FILENAME = "filename must match '{timestamp}_{name}.up.sql' or '{timestamp}_{name}.down.sql'"
LINT_VERSION = 'cannot parse version number "%s": strconv.ParseUint: parsing "%s": value out of range'
LINT_EMPTY = "migration file is empty"
LINT_DUPLICATE = "version %s is duplicated across multiple files: %s"
NO_STATUS = 'version %d: "%s" is no status'
CHANGED_TWICE = "version %d is changed more than once"
REPEATED = "version %d is instructed more than once"
