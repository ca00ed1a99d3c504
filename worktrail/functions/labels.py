"""Fixed label tables."""

from __future__ import annotations

# Friction keys and their labels.
FRICTION_LABELS = {
    "misunderstood_request": "Misunderstood Request",
    "wrong_approach": "Wrong Approach",
    "buggy_code": "Buggy Code",
    "user_rejected_action": "User Rejected Action",
    "assistant_got_blocked": "Assistant Got Blocked",
    "user_stopped_early": "User Stopped Early",
    "wrong_file_or_location": "Wrong File / Location",
    "excessive_changes": "Excessive Changes",
    "slow_or_verbose": "Slow / Verbose",
    "tool_failed": "Tool Failed",
    "user_unclear": "User Unclear",
    "external_issue": "External Issue",
    "user_rephrased": "User Rephrased",
    "agent_wrong_direction": "Agent Wrong Direction",
    "agent_too_slow": "Agent Too Slow",
    "abandoned": "Abandoned",
}

# Words that make a friction key an outcome.
OUTCOME_WORDS = ["resolved", "fixed", "success", "succeeded", "solved", "worked"]

# Labels that differ from the title-cased key.
SPECIAL_LABELS = {
    "debug_investigate": "Debug / Investigate",
    "write_script_tool": "Write Script / Tool",
    "create_pr_commit": "Create PR / Commit",
    "deploy_infra": "Deploy / Infra",
    "warmup_minimal": "Cache Warmup",
    "fast_accurate_search": "Fast / Accurate Search",
    "multi_file_changes": "Multi-file Changes",
    "handled_complexity": "Multi-file Changes",
    "unclear_from_transcript": "Unclear",
}
LABELS = {**SPECIAL_LABELS, **FRICTION_LABELS}

# File extension to language.
LANGUAGES = {
    ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript",
    ".py": "Python", ".rb": "Ruby", ".go": "Go", ".rs": "Rust", ".java": "Java",
    ".md": "Markdown", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".sh": "Shell",
    ".css": "CSS", ".html": "HTML", ".c": "C", ".cpp": "C++", ".cs": "C#", ".kt": "Kotlin",
    ".swift": "Swift",
}

# Failure category per tool.
TOOL_FAILURES = {
    "bash": "Shell Failed", "read": "Read Failed", "write": "Write Failed", "edit": "Edit Failed",
    "glob": "Glob Failed", "grep": "Grep Failed", "task": "Subagent Failed", "eval": "Eval Failed",
    "hub": "Hub Failed", "todo": "Todo Failed", "ask": "Ask Failed", "learn": "Learn Failed",
    "web_search": "Web Search Failed", "manage_skill": "Skill Write Failed",
}

# Tools that only look, and tools that change files.
EXPLORATION_TOOLS = ["read", "grep", "glob", "find", "task", "hub", "ls"]
MUTATION_TOOLS = ["edit", "write", "ast_edit", "notebook_edit"]

# Texts a self-generated session starts with.
SELF_GENERATED_MARKERS = [
    "RESPOND WITH ONLY A VALID JSON OBJECT", "record_facets", "extract structured facets", "At a Glance",
]

# Classes of provider errors, first match wins.
ERROR_CLASSES = [
    ("rate_limit", r"429|rate_limit"),
    ("quota", r"quota"),
    ("auth", r"401|api key|invalidated|unauthori[sz]ed"),
]
