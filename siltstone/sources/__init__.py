"""Where data comes from and goes to: tables, collections, the shared scratch folder."""
