"""From text to a plan: parser, syntax tree, analysis and lowering to a DataFrame."""
