"""Quality checks on 3-D box annotations of LiDAR scenes, written as Spark plans."""
