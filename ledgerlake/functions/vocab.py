"""State vocabularies of the evidence ledgers (fixed values)."""

DEPTHS = ("quick", "standard", "exhaustive")
COVERAGE_STATES = ("checked_hit", "checked_no_confirmation", "blocked", "unchecked")
TERMINAL_REPORT = ("checked_hit", "checked_no_confirmation", "blocked")
TERMINAL_SELECTOR = ("checked_hit", "checked_no_confirmation")
STRENGTHS = ("unknown", "weak_signal", "independent_secondary", "official_secondary", "direct_primary")
FIELD_KINDS = ("static", "slowly_changing", "dynamic")
STAGES = ("discover", "fetch", "render", "parse", "extract")
STATUSES = ("success", "partial", "empty", "blocked", "rate_limited", "timeout", "access_denied", "challenge_blocked",
            "transport_failed", "parse_failed", "invalid_target", "skipped_duplicate", "interrupted")
SUCCESS = ("success", "partial")
NON_FAILURE = ("success", "partial", "skipped_duplicate")
HARD_FAILURE = ("blocked", "access_denied", "challenge_blocked", "invalid_target")
TASK_STATES = ("pending", "leased", "completed", "blocked", "failed", "cancelled")
ACTIVE_TASKS = ("pending", "leased")
FRONTIER_STATES = ("pending", "active", "paused", "exhausted", "blocked")
TERMINAL_FRONTIER = ("exhausted", "blocked")
STOP_DECISIONS = ("continue", "coverage_complete", "discovery_incomplete", "blocked_only", "no_eligible_targets")
#: Version gates: attempts, field contract, control plane, execution routing, adaptive control.
GATES = {"attempts": (1, 1, 0), "field_contract": (1, 2, 0), "targets": (1, 3, 0), "routing": (1, 4, 0), "adaptive": (1, 5, 0)}
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid")
TRACKING_PREFIX = "utm_"
RUNNER_CLASSES = ("lead", "child_agent", "external_cli", "native_tool", "deterministic_code")
MODEL_TIERS = ("strong_reasoning", "balanced", "low_cost")
REASONING_TIERS = ("low", "medium", "high")
ACCEPTANCE_RESULTS = ("unassessed", "passed", "partial", "failed")
FAILURE_CLASSES = ("prompt_contract", "input_evidence", "tool_route", "reasoning_depth", "model_capability", "partition_conflict", "runtime", "other")
CHILD_DECISIONS = ("unassessed", "delegated", "single_lane", "coordination_cost", "unavailable", "unauthorized", "unsafe_shared_state")
EXTERNAL_DECISIONS = ("selected", "duplicate_capability", "unavailable", "auth_blocked", "cost_blocked", "failed_pilot", "not_needed")
SOURCE_STATES = ("ready", "degraded", "blocked", "unknown")
ACCESS_CLASSES = ("public", "internal", "private", "restricted")
STORAGE_STATES = ("stored", "external", "not_retained")
DISCOVERY_MODES = ("unassessed", "bounded_plan", "frontier_ledger", "not_applicable")
DISCOVERY_METHODS = ("bounded_plan", "sitemap", "feed", "category", "pagination", "cursor", "site_search", "query",
                     "identifier_enumeration", "registry", "api", "export", "other")
