"""Session settings and the end-to-end job."""
