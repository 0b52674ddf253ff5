"""Explicit schemas. Category (`1.1`) and date label (`23.10`) look like numbers, so nothing is ever inferred."""

EDITION = (
    "race_id long, race_name string, year int, month int, date_label string, category string, race_type string, "
    "race_country string, race_subtitle string, finishers long, scoring_places long, winner_points double, "
    "top10_points double, total_points double, gc_scoring_places long, gc_winner_points double, gc_top10_points double, "
    "gc_total_points double, stage_count long, stage_pages_parsed long, stage_pages_missing long, "
    "stage_scoring_places long, stage_winner_points double, stage_top10_points double, stage_total_points double, "
    "gc_points_share double, stage_points_share double, startlist_size long, experienced_riders long, "
    "total_startlist_starts double, total_startlist_wins double, total_startlist_podiums double, "
    "total_startlist_top10s double, total_field_form double, top10_field_form double, avg_top10_field_form double, "
    "finish_rate double, points_per_top10_form double, points_per_total_form double"
)
PLANNING = "race_id long, race_name string, category string, date_label string, month int, year int"
ALIAS = "team_slug string, planning_year string, source_race_name string, canonical_race_name string, race_id string"
MANIFEST = (
    "team_slug string, pcs_team_slug string, team_name string, planning_year string, profile_path string, enabled string, notes string"
)
PROGRAMME = "source_race_name string, observed_date string, date_label string, category string, source_url string, pcs_race_slug string"
TEAM_CALENDAR = (
    "team_slug string, team_name string, planning_year int, source string, scraped_at_utc timestamp, race_id long, "
    "race_name string, category string, date_label string, month int, start_date date, end_date date, status string, "
    "team_calendar_status string, source_url string, pcs_race_slug string, observed_race_name string, matched_via string, "
    "notes string, overlap_group string"
)
CHANGELOG = (
    "team_slug string, planning_year int, detected_at_utc timestamp, change_type string, race_id long, race_name string, "
    "old_value string, new_value string, source string, notes string"
)
ACTUAL_POINTS = (
    "team_slug string, team_name string, planning_year int, race_id long, race_name string, category string, "
    "date_label string, status string, actual_points double, rider_count long, source_url string, pcs_race_slug string, "
    "checked_at_utc timestamp, notes string"
)
EV = (
    "team_slug string, team_name string, planning_year int, race_id long, race_name string, category string, "
    "date_label string, month int, start_date date, end_date date, pcs_race_slug string, historical_years_analyzed double, "
    "race_type string, route_profile string, avg_top10_points double, avg_winner_points double, "
    "avg_points_efficiency double, avg_stage_top10_points double, avg_stage_count double, avg_top10_field_form double, "
    "base_opportunity_index double, base_opportunity_points double, one_day_signal double, stage_hunter_signal double, "
    "gc_signal double, time_trial_signal double, all_round_signal double, sprint_bonus_signal double, "
    "specialty_fit_score double, sprint_fit_bonus double, team_fit_score double, team_fit_multiplier double, "
    "participation_confidence double, execution_multiplier double, expected_points double, actual_points double, "
    "ev_gap double, status string, team_calendar_status string, source string, overlap_group string, notes string, "
    "as_of_date date"
)
EV_SUMMARY = (
    "team_slug string, planning_year int, as_of_date date, total_expected_points double, completed_expected_points double, "
    "remaining_expected_points double, actual_points_known double, ev_gap_known double, race_count long, "
    "completed_race_count long, remaining_race_count long"
)
CONTRIBUTION = (
    "scope string, cycle_label string, team_rank int, team_name string, team_slug string, team_class string, "
    "ranking_total_points double, team_total_points double, sanction_points_total double, ranking_url string, "
    "source_url string, scraped_at timestamp, season_year int, rider_name string, rider_slug string, "
    "team_rank_within_counted_list int, points_counted double, points_not_counted double, sanction_points double, "
    "is_placeholder_team_row boolean"
)
PROFILE = (
    "team_slug string, pcs_team_slug string, planning_year int, team_name string, archetype_key string, "
    "archetype_label string, archetype_description string, profile_confidence string, profile_rationale array<string>, "
    "profile_version string, strength_weights map<string,double>, team_fit_floor double, team_fit_range double, "
    "execution_rules map<string,double>, participation_rules map<string,double>, weight_fit_method string, "
    "weight_fit_summary map<string,string>, strength_weight_rationale map<string,string>, "
    "participation_rule_rationale map<string,string>, team_fit_rationale string, execution_rule_rationale string"
)
ARCHETYPE_DOCUMENT = "map<string,struct<label: string, description: string, color: string, strength_weight_prior: map<string,double>>>"
PRESET_DOCUMENT = (
    "struct<preset_version: string, roster_scenario_scope: string, presets: array<struct<key: string, label: string, "
    "description: string, profile_overrides: struct<team_fit_floor: double, team_fit_range: double, "
    "participation_rules: map<string,double>, execution_rules: map<string,double>, strength_weights: map<string,double>>>>>"
)
