"""Pattern libraries and alias tables as data. Users extend them with rows of their own."""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    """One extraction pattern. ``group`` 0 takes the whole match; ``guard`` is a cheap test
    that a text must pass before the pattern is tried (empty: none)."""

    param: str
    kind: str
    pattern: str
    group: int = 1
    guard: str = ""


#: For any text: what occurs in general prose and logs.
GENERIC = [
    Pattern("email", "string", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+", 0, "@"),
    Pattern("ip_address", "string", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0, "."),
    Pattern("long_number", "string", r"[0-9]{16}", 0, ""),
    Pattern("phone", "string", r"\+[0-9]+ \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0, "+"),
    Pattern("token", "string", r'token = "([0-9a-f]{40})"', 1, "token"),
    Pattern("area_code", "integer", r"\+1 \(([0-9]{3})\)", 1, "+1"),
]
#: Used only for parameters that the generic library did not find in a text.
GENERIC_FALLBACK = [
    Pattern("long_number", "string", r"([0-9]{12})", 1, ""),
    Pattern("token", "string", r"([0-9a-f]{32})", 1, ""),
    Pattern("emphasis", "string", r"([A-Z]{3,})!!", 1, "!!"),
]

_NUM = r"([0-9]+(?:\.[0-9]+)?)"
_COUNT = r"([0-9]{1,6})"
#: For reports of motor learning experiments.
MOTOR_LEARNING = [
    Pattern("sample_size_n", "integer", rf"\bn ?= ?{_COUNT}"),
    Pattern("n_total", "integer", rf"\b(?:total of )?{_COUNT} (?:healthy |young |right-handed )*(?:participants|subjects|adults|volunteers)"),
    Pattern("sample_size_per_group", "integer", rf"{_COUNT} (?:participants |subjects )?per group"),
    Pattern("age_mean", "float", rf"(?:mean age|aged?)[ :=]*(?:of )?{_NUM}"),
    Pattern("age_sd", "float", rf"(?:sd|±|\+/-) ?=? ?{_NUM} ?(?:years|yrs)?"),
    Pattern("age_range", "string", r"([0-9]{2} ?(?:-|to) ?[0-9]{2}) ?(?:years|yrs)"),
    Pattern("handedness_criteria", "string", r"(right-handed|left-handed|edinburgh handedness[a-z ]*)"),
    Pattern("gender_distribution", "string", r"([0-9]+ (?:females?|women|males?|men))"),
    Pattern("population_type", "string", r"(healthy (?:young |older )?adults|older adults|cerebellar patients|stroke patients|undergraduates?)"),
    Pattern("effector", "string", r"\b(arm|hand|wrist|finger|leg|eye) (?:reach|movement)"),
    Pattern("environment", "string", r"\b(tablet|kinarm|robotic manipulandum|virtual reality|touch ?screen)\b"),
    Pattern("coordinate_frame", "string", r"\b(horizontal|vertical|polar|cartesian) (?:plane|coordinates?)"),
    Pattern("perturbation_class", "string", r"(visuomotor rotation|force field|gain change|visual shift)"),
    Pattern("perturbation_magnitude", "float", rf"perturbation (?:of |was ){_NUM}"),
    Pattern("rotation_magnitude_deg", "float", rf"{_NUM} ?(?:°|deg(?:rees?)?)[ -](?:visuomotor )?(?:rotation|cw|ccw)"),
    Pattern("rotation_direction", "string", r"\b(counterclockwise|clockwise|ccw|cw)\b"),
    Pattern("force_field_type", "string", r"(velocity-dependent|curl|position-dependent) (?:force )?field"),
    Pattern("force_field_magnitude", "float", rf"{_NUM} ?n ?(?:s|\*s)?/m"),
    Pattern("perturbation_schedule", "string", r"\b(abrupt|gradual|random)(?:ly)?\b"),
    Pattern("schedule_blocking", "string", r"\b(blocked|interleaved|mixed) (?:design|schedule|trials)"),
    Pattern("baseline_trials", "integer", rf"{_COUNT} baseline trials"),
    Pattern("adaptation_trials", "integer", rf"{_COUNT} (?:adaptation|training|rotation) trials"),
    Pattern("washout_trials", "integer", rf"{_COUNT} washout trials"),
    Pattern("retention_trials", "integer", rf"{_COUNT} retention trials"),
    Pattern("catch_trials", "integer", rf"{_COUNT} catch trials"),
    Pattern("num_trials", "integer", rf"(?:total of )?{_COUNT} trials"),
    Pattern("num_blocks", "integer", rf"{_COUNT} blocks"),
    Pattern("feedback_type", "string", r"\b(endpoint|continuous|delayed|clamped|online|no) (?:visual )?feedback"),
    Pattern("feedback_delay_ms", "float", rf"feedback (?:was )?delay(?:ed)? (?:of |by )?{_NUM}"),
    Pattern("cursor_visible", "boolean", r"cursor (?:was )?(visible|hidden|on|off)"),
    Pattern("instruction_awareness", "string", r"\b(informed|instructed|aware|unaware|naive)\b"),
    Pattern("context_cues", "string", r"\b(colou?r|background|lead-in) cues?"),
    Pattern("trial_duration_ms", "float", rf"trial duration (?:of |was )?{_NUM}"),
    Pattern("movement_time", "float", rf"movement time (?:of |was |below )?{_NUM}"),
    Pattern("inter_trial_interval_ms", "float", rf"inter-?trial interval (?:of |was )?{_NUM}"),
    Pattern("retention_interval", "string", r"([0-9]+ ?(?:min(?:utes)?|hours?|h|days?)) (?:later|delay|retention)"),
    Pattern("equipment_manipulandum_type", "string", r"\b(kinarm|phantom|robotic manipulandum|joystick|mouse|stylus)\b"),
    Pattern("number_of_locations", "integer", rf"{_COUNT} (?:possible )?targets?"),
    Pattern("target_size_cm", "float", rf"targets? (?:size |diameter |radius )(?:of |was )?{_NUM}"),
    Pattern("target_distance_cm", "float", rf"{_NUM} ?cm (?:away|from)"),
    Pattern("spacing_deg", "float", rf"spaced {_NUM}"),
    Pattern("center_out", "string", r"(cent(?:er|re)-out)"),
    Pattern("target_hit_criteria", "string", r"\b(shooting|stop at|through) (?:the )?target"),
    Pattern("reward_type", "string", r"\b(monetary|points?|binary) reward"),
    Pattern("error_clamp", "string", r"(error[- ]clamp(?:ed)?)"),
    Pattern("primary_outcomes", "string", r"\b(hand angle|reach angle|aiming|movement error|adaptation rate)\b"),
    Pattern("mechanism_focus", "string", r"\b(implicit|explicit) (?:learning|adaptation|strategy)"),
    Pattern("lab_name", "string", r"\b((?-i:[A-Z][A-Za-z]+ Lab)(?:oratory)?)\b"),
    Pattern("year", "integer", r"\b((?:19|20)[0-9]{2})\b"),
    Pattern("doi_or_url", "string", r"(10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+)"),
    Pattern("dataset_link", "string", r"(https?://(?:osf\.io|github\.com|zenodo\.org)/[A-Za-z0-9_./-]+)"),
    # second readings, for what is written another way round
    Pattern("authors", "string", r"^(?:authors?: ?)((?-i:[A-Z])[^\n]{3,200})$"),
    Pattern("authors", "string", r"^by ((?-i:[A-Z])[\w.'-]+(?: (?-i:[A-Z])[\w.'-]+)+(?:(?:, | and )(?-i:[A-Z])[\w.'-]+(?: (?-i:[A-Z])[\w.'-]+)+)*)$"),
    Pattern("n_total", "integer", rf"recruited {_COUNT} "),
    Pattern("sample_size_n", "integer", rf"sample (?:size )?(?:of|was) {_COUNT}"),
    Pattern("sample_size_per_group", "integer", rf"{_COUNT} in each group"),
    Pattern("age_mean", "float", rf"\bage ?= ?{_NUM}"),
    Pattern("age_range", "string", r"between ([0-9]{2} and [0-9]{2}) years"),
    Pattern("gender_distribution", "string", r"([0-9]+ f(?:emale)?s?[,/] ?[0-9]+ m(?:ale)?s?)\b"),
    Pattern("perturbation_type", "string", r"\b(rotation|force[- ]field|prism|gain|mirror|visual shift)s? (?:perturbation|adaptation)"),
    Pattern("perturbation_magnitude", "float", rf"{_NUM} ?(?:°|deg(?:rees?)?) perturbation"),
    Pattern("rotation_magnitude_deg", "float", rf"rotat(?:ed|ion)(?: (?:by|of|was))* {_NUM} ?(?:°|deg)"),
    Pattern("perturbation_schedule", "string", r"introduced (abruptly|gradually)"),
    Pattern("adaptation_trials", "integer", rf"adaptation (?:phase|block) (?:of|with) {_COUNT} trials"),
    Pattern("baseline_trials", "integer", rf"baseline (?:phase |block )?(?:of|with) {_COUNT} trials"),
    Pattern("washout_trials", "integer", rf"washout (?:phase |block )?(?:of|with) {_COUNT} trials"),
    Pattern("num_trials", "integer", rf"completed {_COUNT} trials"),
    Pattern("num_blocks", "integer", rf"divided into {_COUNT} blocks"),
    Pattern("feedback_delay_ms", "float", rf"{_NUM} ?ms (?:feedback )?delay"),
    Pattern("instruction_type", "string", r"\b(?:were|was) (told|asked|instructed|informed) (?:to|that|about)"),
    Pattern("cue_modalities", "string", r"\b(visual|auditory|haptic|tactile|verbal|proprioceptive) cues?\b"),
    Pattern("context_cues", "string", r"cued? by (colou?r|location|movement)"),
    Pattern("movement_time", "float", rf"within {_NUM} ?m?s of movement"),
    Pattern("inter_trial_interval_ms", "float", rf"\biti (?:of |was )?{_NUM}"),
    Pattern("target_size_cm", "float", rf"{_NUM} ?cm (?:wide |circular )?targets?"),
    Pattern("target_distance_cm", "float", rf"distance of {_NUM} ?cm"),
    Pattern("number_of_locations", "integer", rf"one of {_COUNT} (?:target )?locations"),
    Pattern("outcome_measures", "string", r"(?:outcome|dependent) (?:measures?|variables?) (?:was|were|included) ([^.\n]{4,100})"),
    Pattern("lab_name", "string", r"laboratory of ((?-i:[A-Z])[\w .-]{3,60})"),
    Pattern("year", "integer", r"\(c\) ?((?:19|20)[0-9]{2})"),
    Pattern("doi_or_url", "string", r"doi: ?(\S+)"),
]
#: Used only for parameters that MOTOR_LEARNING did not find in a text: short readings without their context.
MOTOR_FALLBACK = [
    Pattern("sample_size_n", "integer", rf"{_COUNT} (?:people|individuals|volunteers|students)"),
    Pattern("n_total", "integer", rf"{_COUNT} (?:participants|subjects)"),
    Pattern("age_mean", "float", rf"\bage[sd]?\D{{1,12}}{_NUM}"),
    Pattern("age_range", "string", r"\b([0-9]{2} ?(?:-|–|to) ?[0-9]{2})\b"),
    Pattern("handedness_criteria", "string", r"\b((?:right|left)[- ]hand(?:ed)?)\b"),
    Pattern("gender_distribution", "string", r"([0-9]+ ?(?:f|m)\b)"),
    Pattern("rotation_magnitude_deg", "float", rf"{_NUM} ?(?:°|deg)"),
    Pattern("rotation_direction", "string", r"\b(c?cw|(?:anti|counter)?-?clockwise)\b"),
    Pattern("perturbation_class", "string", r"\b(rotation|force[- ]field|prism|gain)\b"),
    Pattern("perturbation_schedule", "string", r"\b(sudden|stepwise|constant)\b"),
    Pattern("adaptation_trials", "integer", rf"{_COUNT} (?:learning|practice|perturbed) trials"),
    Pattern("baseline_trials", "integer", rf"{_COUNT} (?:familiari[sz]ation|warm-?up|null) trials"),
    Pattern("num_trials", "integer", rf"{_COUNT} (?:reaches|movements|trials)"),
    Pattern("num_blocks", "integer", rf"{_COUNT} (?:sessions|runs|blocks)"),
    Pattern("feedback_type", "string", r"\b(visual|cursor|terminal) feedback"),
    Pattern("feedback_delay_ms", "float", rf"delay\D{{1,10}}{_NUM}"),
    Pattern("equipment_manipulandum_type", "string", r"\b(robot|tablet|digiti[sz]er|trackpad|lever)\b"),
    Pattern("number_of_locations", "integer", rf"{_COUNT} (?:goals|locations|directions)"),
    Pattern("target_distance_cm", "float", rf"{_NUM} ?cm"),
    Pattern("instruction_awareness", "string", r"\b(strategy|implicitly|explicitly)\b"),
]

#: Canonical name: type, unit, aliases. Patterns must use these names (checked on load).
SCHEMA = {p.param: (p.kind, None, ()) for p in MOTOR_LEARNING}
# Other names of parameters, as they stand in code, configuration files and sheets.
ALIASES = {
    "rotation_magnitude_deg": "rotation rot rotation_magnitude rotation_angle rotation_deg rot_deg visuomotor_rotation vmr theta angle perturbation pert",
    "rotation_direction": "direction rot_dir rotation_dir clockwise counterclockwise cw ccw",
    "force_field_magnitude": "force ff force_field force_field_strength curl curl_field field_strength viscosity k_force",
    "force_field_type": "field_type ff_type force_type",
    "feedback_delay_ms": "feedback_delay delay visual_delay fb_delay cursor_delay feedback_lag delay_ms temporal_delay",
    "cursor_visible": "cursor show_cursor cursor_on cursor_feedback visual_feedback fb_visual display_cursor",
    "cursor_noise_sd_mm": "cursor_noise noise visual_noise cursor_jitter noise_sd noise_std jitter",
    "num_trials": "n_trials ntrials trials trial_count num_trial n_trial trial_num numtrials total_trials",
    "trial_duration_ms": "trial_duration duration trial_time movement_duration max_time time_limit",
    "movement_time": "mt move_time movement_time_ms",
    "inter_trial_interval_ms": "inter_trial_interval iti inter_trial pause rest_time break_time interval",
    "sample_size_n": "sample_size n num_subjects n_subjects nsubjects participant_count participants sample_n subject_count",
    "n_total": "total_participants n_participants total_n",
    "sample_size_per_group": "n_per_group group_size per_group",
    "age_mean": "age mean_age avg_age age_avg age_average",
    "age_sd": "age_std age_stdev std_age age_stddev",
    "handedness_criteria": "handedness hand dominant_hand hand_preference laterality",
    "gender_distribution": "gender gender_composition sex sex_ratio",
    "equipment_manipulandum_type": "manipulandum manipulandum_type robot robot_type apparatus device interface controller",
    "equipment_workspace_width_cm": "workspace_width width x_range workspace_x x_max x_limit horizontal_range",
    "equipment_workspace_height_cm": "workspace_height height y_range workspace_y y_max y_limit vertical_range",
    "equipment_sampling_rate_hz": "sampling_rate sample_rate fs sampling_freq hz frequency",
    "num_blocks": "n_blocks nblocks blocks block_count",
    "block_type": "phase phase_type condition block_name",
    "baseline_trials": "n_baseline baseline num_baseline",
    "adaptation_trials": "n_adapt training_trials n_training adaptation_length",
    "washout_trials": "n_washout washout num_washout",
    "retention_trials": "n_retention retention num_retention",
    "catch_trials": "n_catch catch",
    "target_distance_cm": "target_distance reach_distance target_dist",
    "target_size_cm": "target_size target_radius target_diameter target_width",
    "number_of_locations": "n_targets num_targets target_count ntargets",
    "spacing_deg": "spacing target_spacing",
    "reward_type": "reward reward_kind reinforcement",
    "instruction_awareness": "awareness instructed aware",
    "outcome_measures": "outcomes measures dependent_variables",
}
_UNITS = {"_deg": "deg", "_ms": "ms", "_cm": "cm", "_mm": "mm", "_hz": "hz"}
_KINDS = {"cursor_noise_sd_mm": "float", "equipment_workspace_width_cm": "float", "equipment_workspace_height_cm": "float", "equipment_sampling_rate_hz": "float", "block_type": "string"}
SCHEMA = {
    name: (SCHEMA[name][0] if name in SCHEMA else _KINDS[name], next((u for end, u in _UNITS.items() if name.endswith(end)), None), tuple(ALIASES.get(name, "").split()))
    for name in [*SCHEMA, *[n for n in ALIASES if n not in SCHEMA]]
}
CRITICAL = ["sample_size_n", "perturbation_class", "perturbation_magnitude", "feedback_type", "adaptation_trials", "environment", "effector", "rotation_magnitude_deg"]


def alias_table(schema=SCHEMA) -> dict[str, str]:
    """Every name and alias to its canonical name; a canonical name always wins."""
    table = {a: name for name, (_, _, aliases) in schema.items() for a in aliases}
    return table | {name: name for name in schema}


def check_library(library: list[Pattern], schema=SCHEMA) -> list[Pattern]:
    unknown = sorted({p.param for p in library} - set(alias_table(schema)))
    if unknown:
        raise ValueError(f"patterns for names outside the schema: {unknown}")
    return library
