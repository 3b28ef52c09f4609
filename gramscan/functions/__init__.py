"""Pattern dialect: parser, translation, literals, replacement templates, case rules."""
