"""The business rules: universe, findings, leads, search, reports, dossier."""
