"""Where facts come from: solution discovery, project files, source texts."""
