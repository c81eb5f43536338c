"""dockcast.sources"""
