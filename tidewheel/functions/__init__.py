"""Column expressions over ordered bars."""
