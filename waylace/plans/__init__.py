"""Plan building blocks: shared scratch tables and set-at-a-time graph rounds."""
