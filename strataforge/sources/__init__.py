"""Files, archives, CSV, Markdown, JSON lines and manifests as DataFrames."""
