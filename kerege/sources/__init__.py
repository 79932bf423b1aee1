"""Where documents come from and results go to."""
