"""DataFrame operators: validation, diagnostics, models, integration, design."""
