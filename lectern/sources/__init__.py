"""Where documents come from: folders of Markdown, or tables."""
