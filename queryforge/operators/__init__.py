"""DataFrame operators: relational blocks, ordered scans, grading, rewards,
episodes, screening, prompts and run analytics."""
