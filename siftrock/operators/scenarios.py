"""Scenarios: every entry point with every family of failures that its type of software is open to.

Families name types or groups of types. The registry is bounded; it becomes a bridge table (type, family) by joins, so that entry points meet it in one
equi-join on the type, and ids are prefix sums over files, not one sorted task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftrock.operators.software import FINGERPRINTS

TYPES = (*(f.name for f in FINGERPRINTS), "unknown_software")


@dataclass(frozen=True)
class Family:
    """``applies``: types, and groups that end in ``_*``, or ALL."""

    name: str
    title: str
    role: str
    applies: tuple[str, ...]
    modes: tuple[str, ...]


# ---- fixed values

#: Groups that aren't all the types that begin like them.
GROUPS = {
    "kernel_*": ("linux_kernel_module", "linux_kernel_tree", "windows_kernel_driver", "bsd_kernel", "macos_kernel_ext"),
    "game_*": ("game_unity", "game_unreal", "game_godot"),
}
FAMILIES = (
    Family("happy_path", "Happy path of {entry}", "authenticated_user", ("ALL",), ("step_skipped", "step_returned_wrong_status", "expected_side_effect_missing")),
    Family(
        "adversarial_input", "{entry} rejects adversarial input", "attacker_external",
        ("web_*", "cli_*", "library_*", "firmware_*", "kernel_*", "compiler_parser", "network_protocol_impl", "database_engine", "browser_ext_*", "ml_training", "data_pipeline_*", "driver_linux_userspace"),
        ("size_check_bypass", "encoding_injection", "unicode_normalization_inconsistency", "out_of_range_numeric", "type_confusion", "parser_recursion_depth_unbounded"),
    ),
    Family(
        "partial_failure", "{entry} handles partial failure mid-operation", "authenticated_user",
        (
            "web_*", "cli_*", "library_python", "library_node", "library_rust", "library_c", "mobile_*", "firmware_*", "rtos_*", "kernel_*", "driver_linux_userspace", "browser_ext_*", "game_*", "desktop_*",
            "iac_*", "data_pipeline_*", "ml_training", "compiler_parser", "network_protocol_impl", "database_engine", "distributed_system", "message_queue_consumer", "websocket_server",
        ),
        ("no_compensation_on_step_failure", "rollback_path_buggy", "silent_swallowed_exception", "double_commit_on_retry", "partial_state_visible"),
    ),
    Family(
        "concurrent_state", "{entry} is safe under concurrent access", "authenticated_user",
        ("web_*", "kernel_*", "driver_linux_userspace", "firmware_*", "rtos_*", "distributed_system", "database_engine", "ml_training", "message_queue_consumer", "websocket_server", "game_*", "desktop_*", "mobile_*"),
        ("race_window_unprotected", "lock_held_during_io", "deadlock_two_resources", "lost_update", "double_free_or_release"),
    ),
    Family(
        "auth_state_transition", "{entry} re-validates auth on state transition", "authenticated_user", ("web_*", "mobile_*", "browser_ext_*", "kernel_*", "desktop_*", "iac_k8s_operator"),
        ("token_expiry_mid_operation", "role_change_not_reread", "permission_revoke_not_propagated", "session_fixation", "auth_check_after_action"),
    ),
    Family("resource_limits", "{entry} respects resource limits", "attacker_external", ("ALL",), ("no_quota_check", "no_oom_handling", "unbounded_allocation", "no_disk_full_handling", "no_stack_depth_limit")),
    Family(
        "interrupt_atomicity", "{entry} preserves atomicity under interrupt", "hardware_interrupt", ("firmware_*", "rtos_*", "kernel_*", "driver_linux_userspace", "os_baremetal"),
        ("isr_modifies_shared_without_lock", "critical_section_not_irq_disabled", "isr_yields_or_blocks", "non_reentrant_function_called_from_isr"),
    ),
    Family(
        "userspace_pointer_validation", "{entry} validates userspace pointer", "userspace_attacker",
        ("linux_kernel_module", "linux_kernel_tree", "windows_kernel_driver", "bsd_kernel", "macos_kernel_ext", "driver_linux_userspace"),
        ("missing_access_ok", "toctou_between_check_and_copy", "copy_size_attacker_controlled", "leak_kernel_memory_on_failure"),
    ),
    Family(
        "dma_race", "{entry} handles CPU/DMA race", "hardware_dma_engine", ("firmware_*", "driver_linux_userspace", "rtos_*", "kernel_*"),
        ("cpu_reads_during_dma_write", "no_cache_invalidate_before_read", "no_cache_flush_before_dma", "dma_buffer_freed_before_completion"),
    ),
    Family(
        "boot_path", "{entry} on boot path", "bootloader", ("firmware_*", "os_baremetal", "kernel_*", "rtos_*"),
        ("uninitialised_peripheral_used", "stack_pointer_set_after_use", "watchdog_not_serviced_during_long_init", "no_brownout_safe_state"),
    ),
    Family(
        "suspend_resume", "{entry} across suspend/resume", "power_event_source", ("firmware_*", "mobile_*", "driver_linux_userspace", "kernel_*", "desktop_*"),
        ("state_not_persisted_before_suspend", "interrupt_pending_lost_on_resume", "peripheral_state_not_restored", "race_on_wake_with_pending_work"),
    ),
    Family(
        "hardware_failure", "{entry} handles hardware failure", "hardware_interrupt", ("firmware_*", "driver_linux_userspace", "rtos_*", "kernel_*", "fpga_*"),
        ("no_timeout_on_peripheral_wait", "no_retry_or_degraded_mode", "no_failure_indication_to_caller", "infinite_loop_on_bus_error"),
    ),
    Family(
        "protocol_replay", "{entry} rejects replayed protocol message", "network_peer_malicious",
        ("web_*", "network_protocol_impl", "firmware_*", "crypto_library", "browser_ext_*", "websocket_server", "message_queue_consumer"),
        ("no_nonce_check", "nonce_window_too_wide", "replay_within_session_accepted", "no_message_ordering_check"),
    ),
    Family(
        "downgrade_attack", "{entry} rejects protocol downgrade", "network_peer_malicious", ("crypto_library", "network_protocol_impl", "web_*", "browser_ext_*", "mobile_*"),
        ("weak_cipher_acceptable", "no_version_pinning", "no_renegotiation_check", "fallback_path_unauthenticated"),
    ),
    Family(
        "persistence_corruption", "{entry} survives persistence corruption", "power_event_source",
        ("web_*", "kernel_*", "firmware_*", "rtos_*", "database_engine", "distributed_system", "iac_*", "mobile_*", "desktop_*", "data_pipeline_*", "ml_training"),
        ("no_fsync_on_commit", "torn_write_visible", "no_checksum_on_record", "rename_not_atomic", "wal_truncated_silently"),
    ),
    Family(
        "ipc_message_malformed", "{entry} rejects malformed IPC message", "peer_service", ("os_baremetal", "kernel_*", "browser_ext_*", "mobile_*", "distributed_system", "desktop_*"),
        ("no_length_validation", "no_type_validation", "trust_unsigned_peer", "deserialization_of_untrusted_class"),
    ),
    Family(
        "upgrade_migration", "{entry} survives upgrade/migration", "ci_system",
        ("web_*", "mobile_*", "database_engine", "distributed_system", "iac_*", "data_pipeline_*", "firmware_*", "kernel_*", "ml_training", "browser_ext_*"),
        ("no_downgrade_path", "partial_migration_state_unrecoverable", "schema_assumption_drift_between_services", "rollback_loses_data"),
    ),
    Family(
        "user_input_event", "{entry} handles user input event", "authenticated_user", ("mobile_*", "desktop_*", "game_*", "browser_ext_*", "webgl_three"),
        ("double_tap_triggers_twice", "background_event_resumes_in_wrong_state", "permission_dialog_dismissed_treated_as_grant", "back_button_loses_unsaved_state"),
    ),
    Family(
        "scheduler_starvation", "{entry} avoids scheduler starvation", "os_scheduler", ("rtos_*", "os_baremetal", "kernel_*", "distributed_system", "data_pipeline_*"),
        ("low_priority_task_never_runs", "priority_inversion", "leader_election_stuck", "consumer_starved_by_producer"),
    ),
    Family(
        "backpressure", "{entry} applies backpressure", "network_peer_benign", ("data_pipeline_*", "web_*", "distributed_system", "network_protocol_impl", "websocket_server", "message_queue_consumer"),
        ("unbounded_queue_growth", "no_drop_or_throttle_policy", "producer_blocks_forever", "load_shedding_drops_critical_messages"),
    ),
    Family(
        "clock_skew", "{entry} tolerates clock skew", "peer_service", ("distributed_system", "crypto_library", "mobile_*", "web_*", "network_protocol_impl", "kernel_*"),
        ("expiry_check_uses_local_time", "skew_window_too_narrow", "monotonic_vs_wall_clock_confused", "leader_lease_breaks_on_minor_skew"),
    ),
    Family(
        "sandbox_escape", "{entry} prevents sandbox escape", "attacker_internal", ("browser_ext_*", "mobile_*", "os_baremetal", "kernel_*", "desktop_electron", "desktop_tauri"),
        ("permission_check_bypass", "ipc_to_more_privileged_peer_unchecked", "file_uri_leak_through_redirect", "intent_hijack_or_url_scheme_takeover"),
    ),
    Family(
        "dependency_compromise", "{entry} robust to dependency compromise", "attacker_external", ("ALL",),
        ("unpinned_dependency_version", "supply_chain_unverified_signature", "transitive_dep_with_known_cve", "build_script_executes_untrusted_code"),
    ),
    Family(
        "signal_integrity", "{entry} signal integrity / metastability", "hardware_interrupt", ("fpga_*", "asic_design", "firmware_*"),
        ("metastability_on_async_crossing", "no_cdc_synchroniser", "setup_or_hold_time_violation", "long_combinational_path"),
    ),
    Family(
        "timing_constraint_violation", "{entry} respects timing constraints", "hardware_interrupt", ("fpga_*", "asic_design", "rtos_*", "firmware_*"),
        ("deadline_missed_under_load", "isr_jitter_too_high", "clock_constraint_unsatisfied", "back_pressure_violates_deadline"),
    ),
    Family(
        "watchdog_misuse", "{entry} watchdog usage is correct", "watchdog", ("firmware_*", "rtos_*", "kernel_*", "os_baremetal"),
        ("watchdog_disabled_during_critical_section", "watchdog_petted_inside_a_hang", "watchdog_reset_loses_state", "watchdog_window_too_wide"),
    ),
    Family(
        "power_glitch", "{entry} robust to power glitch / fault injection", "brownout_detector", ("firmware_*", "os_baremetal", "crypto_library"),
        ("no_brownout_aware_critical_section", "fault_injection_skips_security_check", "voltage_drop_during_flash_write"),
    ),
    Family(
        "side_channel", "{entry} resistant to side-channel leakage", "attacker_external", ("crypto_library", "firmware_*", "kernel_*"),
        ("non_constant_time_compare", "key_dependent_branch_or_memory_access", "cache_timing_leak", "power_or_em_emanation"),
    ),
    Family(
        "concurrency_in_parser", "{entry} parser thread-safe", "network_peer_benign", ("compiler_parser", "network_protocol_impl", "web_*"),
        ("shared_lexer_state", "buffer_reuse_across_concurrent_parses", "thread_unsafe_globals"),
    ),
    Family(
        "memory_safety_uaf", "{entry} no use-after-free", "attacker_external",
        ("firmware_*", "kernel_*", "driver_linux_userspace", "game_engine", "desktop_qt", "desktop_gtk", "network_protocol_impl", "library_c", "database_engine", "compiler_parser"),
        ("use_after_free", "double_free", "dangling_pointer_in_signal_handler", "concurrent_free_and_use"),
    ),
    Family(
        "memory_safety_bounds", "{entry} bounds-checked", "attacker_external",
        ("firmware_*", "kernel_*", "driver_linux_userspace", "game_engine", "desktop_qt", "desktop_gtk", "network_protocol_impl", "library_c", "database_engine", "compiler_parser"),
        ("off_by_one_in_loop", "size_attacker_controlled", "no_buffer_check_in_copy", "negative_index_passed_through"),
    ),
    Family(
        "integer_overflow_in_size_calc", "{entry} no integer overflow in size calc", "attacker_external",
        ("kernel_*", "driver_linux_userspace", "firmware_*", "compiler_parser", "network_protocol_impl", "database_engine", "crypto_library", "library_c"),
        ("multiplication_overflow_for_alloc_size", "addition_overflow_for_buffer_size", "signed_unsigned_confusion", "truncation_loses_high_bits"),
    ),
    Family(
        "privilege_escalation", "{entry} prevents privilege escalation", "attacker_internal", ("kernel_*", "driver_linux_userspace", "browser_ext_*", "desktop_*", "mobile_*"),
        ("setuid_binary_unsafe_env_var", "ioctl_capable_for_unprivileged_user", "extension_requests_overbroad_permission", "deeplink_grants_unintended_action"),
    ),
    Family(
        "race_in_setuid_or_setgid", "{entry} setuid/setgid race-free", "attacker_internal", ("kernel_*", "os_baremetal", "cli_*"),
        ("drop_privileges_after_action", "file_op_between_check_and_use", "saved_uid_not_dropped"),
    ),
)
#: What names an entry point of a kind that has this metadata; ``{symbol}`` is its own.
LABELS = (
    ("http_route", ("method", "path"), "{method} {path}"),
    ("cli_command", ("command",), "{command}"),
    ("isr_vector", ("vector",), "ISR {vector} ({symbol})"),
    ("syscall_handler", ("cmd",), "syscall {cmd} ({symbol})"),
)
DEFAULT = "Default for {family}: see the failure modes of the family."


def members(spark: SparkSession, types: Sequence[str] = TYPES, groups: dict[str, Sequence[str]] = GROUPS) -> DataFrame:
    """(item, type): what each name stands for: a type for itself, ALL for every one, a group for its list or the types that begin like it."""
    all_types = spark.createDataFrame([(t,) for t in types], "type string")
    listed = spark.createDataFrame([(g, t) for g, some in groups.items() for t in some], "item string, type string").join(all_types, "type", "left_semi")
    own = all_types.select(F.col("type").alias("item"), "type").unionByName(all_types.select(F.lit("ALL").alias("item"), "type"))
    heads = F.transform(F.sequence(F.lit(1), F.size(F.split("type", "_"))), lambda i: F.concat(F.array_join(F.slice(F.split("type", "_"), 1, i), "_"), F.lit("_*")))
    alike = all_types.select(F.explode(heads).alias("item"), "type").where(~F.col("item").isin(*groups)) if groups else all_types.select(F.explode(heads).alias("item"), "type")
    return own.unionByName(listed).unionByName(alike)


def bridge(spark: SparkSession, families: Sequence[Family] = FAMILIES, types: Sequence[str] = TYPES, groups: dict[str, Sequence[str]] = GROUPS) -> DataFrame:
    """(type, family): every family of every type, once."""
    applies = spark.createDataFrame([(f.name, i) for f in families for i in f.applies], "family string, item string")
    return applies.join(members(spark, types, groups), "item").select("type", "family").distinct()


def _filled(template: str, **values: Column) -> Column:
    """``template`` with its names in braces filled."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def label() -> Column:
    """The short name of an entry point (kind, symbol, metadata: a map of texts) in titles."""
    has = lambda k: F.map_contains_key("metadata", F.lit(k))
    out = F.lit(None).cast("string")
    for kind, keys, template in reversed(LABELS):
        holds = F.col("kind") == kind
        for k in keys:
            holds = holds & F.coalesce(has(k), F.lit(False))
        out = F.when(holds, _filled(template, **{k: F.element_at("metadata", F.lit(k)) for k in keys}, symbol=F.col("symbol"))).otherwise(out)
    return F.coalesce(out, F.col("symbol"))


def scenarios(points: DataFrame, families: Sequence[Family] = FAMILIES, *, by: Sequence[str] = ()) -> DataFrame:
    """A row for every entry point and family of its type, with ids from SCEN-0001 in the order of type, file, line, symbol and family.

    points: type_origin, kind, file, line, symbol, docstring (may be null), metadata (a map of texts); of points equal in type, file, line and symbol the least counts. ``by``: columns
    of a set of files; ids are counted in each. What is numbered one after another in a task is the scenarios of one file.
    """
    spark = points.sparkSession
    key = [*by, "type_origin", "file", "line", "symbol"]
    rest = ["kind", "docstring"]
    points = points.select(*key, *rest, F.array_sort(F.map_entries("metadata")).alias("entries"))
    points = points.groupBy(*key).agg(F.min(F.struct(*rest, "entries")).alias("p")).select(*key, *[f"p.{c}" for c in rest], F.map_from_entries("p.entries").alias("metadata"))
    about = spark.createDataFrame([(f.name, f.title, f.role, list(f.modes)) for f in families], "family string, title string, actor_role string, failure_modes_to_test array<string>")
    opened = F.broadcast(bridge(spark, families).withColumnRenamed("type", "type_origin").join(about, "family"))  # types x families of the registry, whatever the data
    rows = points.join(opened, "type_origin")
    group = [*by, "type_origin", "file"]
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy(*by).orderBy("type_origin", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    base = sizes.select(*group, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("line", "symbol", "family"))
    rows = rows.join(base, group).withColumn("place", F.col("base") + place)
    intended = F.regexp_replace(F.coalesce("docstring", F.lit("")), r"^\s+|\s+$", "")
    return rows.select(
        *by,
        F.format_string("SCEN-%04d", "place").alias("id"),
        "type_origin",
        "family",
        F.replace("title", F.lit("{entry}"), label()).alias("title"),
        F.struct("kind", "file", "line", "symbol", "metadata").alias("entry_point"),
        "actor_role",
        F.struct(F.concat("family", F.lit("_default")).alias("kind"), F.struct(F.col("symbol").alias("entry_point"), "metadata").alias("value")).alias("stimulus"),
        F.when(intended != "", intended).otherwise(_filled(DEFAULT, family=F.col("family"))).alias("intended_behaviour"),
        "failure_modes_to_test",
        "place",
    )
