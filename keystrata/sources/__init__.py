"""Where logs and runs are kept."""
