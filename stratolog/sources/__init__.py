"""Where logs come from: tables, files and folders."""
