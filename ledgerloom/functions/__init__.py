"""Column expressions; all but html.select_links stay in the JVM."""
