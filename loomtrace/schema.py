"""Schemas of the tables. All times are timestamps; arrays are arrays; ids are strings or longs."""

from __future__ import annotations

LINES = "session_id string, path string, line_no bigint, byte_offset bigint, byte_length bigint, line string"

MESSAGE = (
    "session_id string, sequence_num bigint, role string, event_type string, content_preview string, search_content string, "
    "has_code boolean, has_error boolean, has_file_changes boolean, tool_name string, tool_type string, tool_summary string, "
    "input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint, model string, "
    "timestamp string, ts timestamp, byte_offset bigint, byte_length bigint"
)

TABLES: dict[str, str] = {
    "projects": "id string, name string, folder_path string, description string, repo_url string, language string, framework string, auto_sync boolean, longest_streak bigint, created_at timestamp, updated_at timestamp",
    "sessions": (
        "id string, project_id string, file_path string, title string, ai_tool string, message_count bigint, duration_ms bigint, has_code boolean, has_errors boolean, file_size bigint, file_modified timestamp, "
        "archived_file_path string, archived_at timestamp, title_edited boolean, title_ai_generated boolean, memories_extracted_at timestamp, memories_extracted_count bigint, skills_extracted_at timestamp, skills_extracted_count bigint, "
        "import_status string, import_error string, is_hidden boolean, created_at timestamp, indexed_at timestamp"
    ),
    "session_messages": MESSAGE,
    "memories": (
        "id bigint, project_id string, session_id string, memory_type string, title string, content string, context string, tags array<string>, confidence double, is_validated boolean, extracted_at timestamp, "
        "file_reference string, state string, access_count bigint, last_accessed_at timestamp"
    ),
    "memory_embeddings": "memory_id bigint, embedding array<float>",
    "memory_settings": "id bigint, model_downloaded boolean, model_path string, last_extraction timestamp, total_memories_extracted bigint",
    "skills": "id bigint, project_id string, session_id string, name string, description string, steps array<string>, confidence double, extracted_at timestamp",
    "skill_embeddings": "skill_id bigint, embedding array<float>",
    "skill_sessions": "skill_id bigint, session_id string, added_at timestamp",
    "session_markers": "id bigint, session_id string, event_index int, marker_type string, label string, description string, created_at timestamp",
    "session_context": "session_id string, project_id string, active_task string, recent_decisions array<string>, open_questions array<string>, resume_context string, source string, created_at timestamp, updated_at timestamp",
    "instance_metadata": "id bigint, uuid string, instance_name string, created_at timestamp",
    "file_state": "path string, session_id string, file_size bigint, message_count bigint, max_sequence bigint, next_line bigint",
    "memory_access": "memory_id bigint, accessed_at timestamp",
    "calls": "session_id string, id string, call_name string, call_input string, is_call boolean, line_no bigint",
    "service_events": "event string, session_id string, payload string, at timestamp",
}

#: Primary keys, and child table -> (own column, parent table) for cascading deletes.
KEYS = {
    "projects": ["id"], "sessions": ["id"], "session_messages": ["session_id", "sequence_num"], "memories": ["id"], "memory_embeddings": ["memory_id"], "memory_settings": ["id"], "skills": ["id"],
    "skill_embeddings": ["skill_id"], "skill_sessions": ["skill_id", "session_id"], "session_markers": ["id"], "session_context": ["session_id"], "instance_metadata": ["id"], "file_state": ["path"], "calls": ["session_id", "id"],
}
CHILDREN = {
    "projects": [("sessions", "project_id"), ("memories", "project_id"), ("skills", "project_id"), ("session_context", "project_id")],
    "sessions": [("session_messages", "session_id"), ("memories", "session_id"), ("skills", "session_id"), ("skill_sessions", "session_id"), ("session_markers", "session_id")],
    "memories": [("memory_embeddings", "memory_id")],
    "skills": [("skill_embeddings", "skill_id"), ("skill_sessions", "skill_id")],
}
#: What a checked column may hold.
CHECKS = {
    ("memories", "memory_type"): ("decision", "fact", "preference", "context", "task"),
    ("memories", "state"): ("new", "low", "high", "removed"),
    ("session_markers", "marker_type"): ("breakthrough", "ship", "decision", "bug", "stuck"),
    ("sessions", "import_status"): ("success", "failed"),
}
