"""dockcast.streaming"""
