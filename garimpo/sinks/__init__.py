"""Writers: stage tables, the lead sheet, load counts."""
