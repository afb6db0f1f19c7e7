"""Schemas of the tables that operators exchange, as DDL."""

TURNS = "dialogue_id string, turn_index int, speaker string, text string, timestamp string, start_offset double, end_offset double"
MATCHES = (
    "dialogue_id string, phrase_text string, matched_text string, matched_start int, matched_end int, quarter string, turn_index int, speaker string, match_type string, "
    "word_distance_used int, cascade_order int, is_exact_match boolean, word_distance int, channel_constraint string, dict_level int, is_remainder boolean"
)
CHUNKS = "dialogue_id string, turn_index int, speaker string, chunk_index int, text string, chunk_type string, token_count int, char_count int"
JOBS = "job_id string, kind string, status string, total int, processed int, created_at timestamp, updated_at timestamp"

CLIENT, OPERATOR, UNKNOWN = "Клиент", "Сотрудник", "Неизвестный"
CHANNELS = {"CLIENT": CLIENT, "OPERATOR": OPERATOR}
